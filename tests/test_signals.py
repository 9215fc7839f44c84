"""Signals, gate and model plumbing on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from quillspan.operators import ask, learned, signals


def test_retrieval_signals(spark):
    r = spark.createDataFrame([("q", 1, 10, 0.9), ("q", 2, 11, 0.4), ("q", 3, 12, float("nan")), ("q", 4, 13, None), ("q", 6, 14, 0.1)], "qid string, rank int, pid long, hybrid double")
    q = spark.createDataFrame([("q", "Which old ship  sank"), ("z", "nothing")], "qid string, question string")
    p = spark.createDataFrame([(10, "The ship was old.")], "pid long, text string")
    row = signals.retrieval_signals(r, q, p).first()
    assert row["r_sim_top1"] == 0.9 and row["r_sim_margin"] == pytest.approx(0.5) and row["r_sim_mean_k"] == pytest.approx(0.65)
    assert row["r_n_above_tau"] == 2 and row["r_lex_overlap"] == pytest.approx(0.5) and row["r_q_len"] == 4
    w = [x - 0.1 + 1e-9 for x in (0.9, 0.4, 0.1)]
    assert row["r_sim_entropy"] == pytest.approx(-sum(x / sum(w) * math.log(x / sum(w) + 1e-12) for x in w))


def test_agreement_signals(spark):
    read = spark.createDataFrame([("q", 1, 10, "The Nile", 0.2), ("q", 2, 11, "nile", 0.9), ("q", 3, 12, "", 0.1)], "qid string, rank int, pid long, answer string, raw double")
    p = spark.createDataFrame([(11, "On the NILE river")], "pid long, text string")
    row = signals.agreement_signals(read, p).first()
    assert (row["a_n_nonnull"], row["a_top2_string_sim"], row["a_majority_frac"], row["a_answer_in_top2"]) == (2, 1, 1, 1)


def test_softmax(spark):
    rows = signals.softmax(spark.createDataFrame([("q", 0.1), ("q", 0.3)], "qid string, raw double"), ["qid"], "raw").orderBy("raw").collect()
    p = math.exp(2) / (1 + math.exp(2))
    assert rows[1]["prob"] == pytest.approx(p) and rows[0]["entropy"] == pytest.approx(-(p * math.log(p) + (1 - p) * math.log(1 - p)))


def test_gate_and_reasons(spark):
    rows = spark.createDataFrame([(0.6, "x", 0.4, 0.0, 0.2, 0.05), (0.5, "y", 0.4, 0.0, 0.2, 0.05)], "risk double, candidate string, r_sim_top1 double, a_answer_in_top2 double, a_majority_frac double, d_span_prob double")
    a, b = ask.gate(rows, 0.5).orderBy(F.desc("risk")).collect()
    assert a["abstained"] and a["answer"] is None and a["reason"] == "; ".join(ask.REASONS.values())
    assert not b["abstained"] and b["answer"] == "y" and b["reason"] == ""


@pytest.mark.parametrize(("question", "threshold", "k"), [("", None, None), (" ", None, None), ("x", 1.5, None), ("x", None, 0), ("x", None, 21)])
def test_requests(question, threshold, k):
    with pytest.raises(ValueError):
        ask.check_request(question, threshold, k)
    ask.check_request("x", 0.5, 5)


def test_highlight(spark):
    row = spark.createDataFrame([("The Nile flows", "Nile"), ("dry", "Nile"), ("dry", None)], "t string, a string").select(ask.highlight(F.col("t"), F.col("a"))).collect()
    assert [r[0] for r in row] == ["The **Nile** flows", "dry", "dry"]


def test_risk_model(spark, tmp_path):
    rows = spark.createDataFrame([(float(k % 10), float(k % 3), float(k % 10 > 5)) for k in range(200)], "x double, y double, error double")
    model = learned.RiskModel(["x", "y"], iterations=3).fit(rows).calibrate(rows)
    out = model.risk(rows)
    assert out.where("risk < 0 OR risk > 1").count() == 0
    assert out.groupBy("error").agg(F.avg("risk").alias("r")).orderBy("error").collect()[1]["r"] > 0.9
    model.save(str(tmp_path / "m"))
    again = learned.load_risk_model(str(tmp_path / "m")).risk(rows)
    assert again.agg(F.sum("risk")).first()[0] == pytest.approx(out.agg(F.sum("risk")).first()[0])


def test_assembly_checks_names(spark):
    a = spark.createDataFrame([("q", *[0.5] * 7)], ["qid", *signals.RETRIEVAL])
    b = spark.createDataFrame([], ", ".join(["qid string", *[f"{c} double" for c in signals.READER]]))
    c = spark.createDataFrame([], ", ".join(["qid string", *[f"{c} double" for c in signals.AGREEMENT]]))
    row = signals.assemble(a, b, c).first().asDict()
    assert list(row)[1:] == signals.SIGNALS and row["d_null_score"] == 1.0 and row["a_n_nonnull"] == 0


def test_end_to_end(spark, tmp_path):
    import json

    from quillspan.operators import retrieval

    names = ["Vale", "Ines", "Ruiz", "Dean", "Kell", "Moss"]
    places = ["harbour", "tower", "mill", "bridge", "market", "school"]
    ps = [(k, f"art{k // 3}", f"{n} painted the {p} in {1400 + 10 * k}. The {p} stood near the river. Later it burned.") for k, (n, p) in enumerate((n, p) for n in names for p in places)]
    qs = [(f"q{k}", f"art{k // 3}", k, f"Who painted the {places[k % 6]} in {1400 + 10 * k}?" if k % 4 else f"Who sold the {places[k % 6]}?", [names[k // 6]] if k % 4 else [], k % 4 == 0) for k in range(36)]
    p = retrieval.corpus(spark.createDataFrame(ps, "pid long, article string, text string"))
    q = spark.createDataFrame(qs, "qid string, article string, gold_pid long, question string, answers array<string>, is_impossible boolean")
    reader = learned.Reader(retrieval.idf(p), per_positive=10, iterations=3).fit(q, p)
    answered = ask.answer(q.select("qid", "article", "gold_pid", "question"), p, reader).persist()
    rows = answered.collect()
    assert len(rows) == 36 and all(r[c] is not None and math.isfinite(r[c]) for r in rows for c in signals.SIGNALS)
    assert all(0 <= r["d_span_prob"] <= 1 and 0 <= r["d_null_score"] <= 1 and r["retrieved"] for r in rows)
    labelled = answered.withColumn("error", (F.col("d_span_len") > 1).cast("double"))
    risk = learned.RiskModel(iterations=2).fit(labelled).calibrate(labelled)
    user = spark.createDataFrame([("u", "Who painted the tower?"), ("v", "zzz")], "qid string, question string")
    got = {r["qid"]: r for r in ask.ask(user, p, reader, risk, 2.0).collect()}
    assert got["u"]["answer"] == got["u"]["candidate"] and not got["u"]["abstained"] and got["u"]["passage"]
    body = {r["qid"]: json.loads(r["body"]) for r in ask.as_json(ask.ask(user, p, reader, risk, -1.0)).collect()}
    assert body["u"]["answer"] is None and body["u"]["abstained"] and len(body["u"]["features"]) == 16
    ask.append_log(ask.ask(user, p, reader, risk, 0.5), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == len(got)
    assert ask.unfinished(q, answered).count() == 0
    assert len(body["u"]["evidence"]) == 5 and body["u"]["evidence"][0]["text"] and set(body["u"]["timing_ms"]) == {"retrieval", "reader", "features"}
    reader.save(str(tmp_path / "reader"))
    from quillspan.operators.service import Service

    service = Service(spark, p, learned.load_reader(str(tmp_path / "reader")), risk, 2.0)
    assert service.handle("GET", "/health") == (200, {"status": "ok", "passages": 36}) and service.handle("GET", "/evaluate")[0] == 404
    assert service.handle("POST", "/ask", {"question": " "})[0] == 422 and service.handle("GET", "/x")[0] == 404
    status, out = service.handle("POST", "/ask", {"question": "Who painted the tower?"})
    assert status == 200 and out["answer"] == got["u"]["answer"] and out["risk"] == pytest.approx(got["u"]["risk"])


def test_descriptions(spark):
    got = {r["method"]: r["description"] for r in learned.described(spark.createDataFrame([("B1",), ("zz",)], "method string")).collect()}
    assert got == {"B1": "always answer", "zz": None}
