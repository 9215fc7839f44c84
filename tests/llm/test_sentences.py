"""Sentence ends on written-out cases, after training on lines."""

import pytest

from quillspan.llm import sentences as S
from quillspan.llm.chain import Chain, fit

LINES = [
    "Dr. Vale painted the harbour.", "The tower of St. Ives (built ca. 1210) fell.", "It weighs 6.5 kg, i.e. 3.1 times a stone.", "“Stop the boat!” cried Ines near the pier.", 'Ines asked, "Who drew the map?"',
    "Was the old bridge ever finished?!", "He wrote: ‘The river joined us.’", "The guild waited ... and the market closed.", "(The pottery named Ines.)", "J. K. Vale copied the tower, the map, etc.",
    "The choir met at 4 p.m.", "Mr. and Mrs. Vale moved No. 12 Dean St. near the mill.", "Vale Ltd. sold the mill beside Dean Inc.", "The U.N.-style tower fell.", "In Sept. 1720, the harbour burned.",
]
CJK = ["王朝は「港はどこですか。」と聞いた。", "（寺院は王が記録した。）", "1409年に、王は港を守った。", "橋の高さは48.79メートルだ！", "誰が港を測ったのか？"]
THAI = ["ป้อมสร้าง 16 ครั้ง", "ใครปกป้องคลองของเมือง", "ในปี 1537 เลโมออกแบบสภา", "คลองสูง 83.5 เมตร"]


@pytest.fixture(scope="module")
def chain(spark):
    import random

    pick = random.Random(1)
    rows = []
    for group, times in ((LINES, 160), (CJK, 40), (THAI, 40)):
        for _ in range(times):
            rows.append(("\n".join(pick.sample(group, 4)),))
    return S.fit_boundaries(spark.createDataFrame(rows, "t string"), "t")


def cut(text, chain):
    return [text[a:b] for a, b in S.sentences_of(text, chain)]


@pytest.mark.parametrize("group", [LINES, CJK, THAI])
def test_joined_lines_come_apart(chain, group):
    join = "" if group is CJK else " "
    for k in range(len(group)):
        turned = group[k:] + group[:k]
        assert cut(join.join(turned), chain) == turned


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), (" \n ", []), (" ... !! ", []),
        ("A heading\nThe tower fell. The mill burned", ["A heading", "The tower fell.", "The mill burned"]),
        ("The tower fell. The mill burned.", ["The tower fell.", "The mill burned."]),
        ("  The tower fell.   ", ["The tower fell."]),
        ("The tower fell.\n***\nThe mill burned.", ["The tower fell.", "The mill burned."]),
    ],
)
def test_plain_cases(chain, text, want):
    assert cut(text, chain) == want


def test_frame(spark, chain):
    rows = spark.createDataFrame([(1, "The tower fell. The mill burned.", 3), (None, "One.", 4), (3, None, 5)], "pid long, text string, sent_end int")
    got = S.sentences(rows, "pid", "text", chain).collect()
    assert [(r["pid"], r["sent_idx"], r["sent_start"], r["sent_end"]) for r in got] == [(1, 0, 0, 15), (1, 1, 16, 32), (None, 0, 0, 4)]
    none = spark.createDataFrame([], "pid long, text string")
    assert S.sentences(none, "pid", "text").count() == 0


def unpunctuated(pick, n):
    """Sentences of Japanese and of Chinese, made of parts."""
    ja = (["王朝は", "寺院の僧は", "市場の商人は", "若い画家が", "町の人々も", "川の南で兵士が"], ["港を", "古い橋を", "大きな地図を", "丘の上の塔を", "冬の祭りを", "新しい船を"], ["守った", "測った", "記録した", "建てました", "忘れなかった", "描いていた"])
    zh = (["王朝", "寺院的僧人", "市场的商人", "年轻的画家", "城里的人们"], ["守护了", "测量过", "记录了", "建造了", "没有忘记"], ["港口", "古老的桥", "山上的塔", "冬天的节日", "新的船只"])
    return ["".join(pick.choice(part) for part in kind) for kind in (pick.choice([ja, zh]) for _ in range(n))]


def test_unpunctuated_text_without_blanks(spark):
    """Held-out sentences without any mark come apart; the chain has learned from sentences with theirs stripped."""
    import random

    pick = random.Random(6)
    rows = [("".join(x + "。" for x in unpunctuated(pick, 6)),) for _ in range(300)]
    model = S.fit_boundaries(spark.createDataFrame(rows, "t string"), "t")
    right = wrong = lost = 0
    for _ in range(60):
        parts = unpunctuated(pick, 10)
        want, at = set(), 0
        for x in parts:
            at += len(x)
            want.add(at)
        got = {b for _, b in S.sentences_of("".join(parts), model)}
        right, wrong, lost = right + len(want & got), wrong + len(got - want), lost + len(want - got)
    assert right / (right + lost) > 0.95 and right / (right + wrong) > 0.95
    heading = "古い橋の歴史"
    assert [heading[a:b] for a, b in S.sentences_of(heading, model)] == [heading]


def test_stops_of_unstopped_scripts_are_stripped_in_training():
    sequences, _ = S._training(["\n".join(f"{t}." for t in THAI)])
    assert sequences and not any("stop" in f for s in sequences for f in s)


def test_long_text(chain):
    assert len(cut(" ".join(LINES * 300), chain)) == 300 * len(LINES)


def test_viterbi_is_the_best_tagging():
    import itertools

    chain = Chain({}, [[0.3, -0.7], [0.9, -1.2]], [0.1, -0.4])
    scores = [0.5, -0.2, 1.3, 0.4, -0.9]

    def value(tags):
        return chain.start[tags[0]] + sum(s for s, t in zip(scores, tags) if t) + sum(chain.move[a][b] for a, b in zip(tags, tags[1:]))

    assert chain.viterbi(scores) == list(max(itertools.product((0, 1), repeat=5), key=value)) and chain.viterbi([]) == []


def test_fit_learns_moves():
    seqs = [[["x"]] * 6] * 40
    chain = fit(seqs, [[0, 1, 0, 1, 0, 1]] * 40)
    assert chain.tag(seqs[0]) == [0, 1, 0, 1, 0, 1] and fit([], []).tag([["x"]]) == [0]
