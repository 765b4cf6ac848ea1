import sys
from collections import Counter
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline as C  # noqa: E402

from tests.llm import test_op1, test_op9  # noqa: E402

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows in, rows out) of each stage, rows as dictionaries."""
    docs, out = C.table(spark, SF, "documents"), []
    for i, (name, stage) in enumerate(C.STAGES):
        got = C.saved(stage(spark, docs, SF), f"test-{name}")
        if i < len(C.STAGES) - 1:
            assert got.columns == docs.columns and [f.dataType for f in got.schema] == [f.dataType for f in docs.schema]
        out.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in got.collect()]))
        docs = got
    return {name: (a, b) for name, a, b in out}


def ids(rows):
    return [r["doc_id"] for r in rows]


def test_toxicity_rejects_what_the_model_scores(spark, stages):
    before, after = stages["toxicity"]
    labels = {r.doc_id: r.toxic for r in C.table(spark, SF, "labels").collect()}
    gone = set(ids(before)) - set(ids(after))
    assert {tuple(r.values()) for r in after} <= {tuple(r.values()) for r in before}
    assert sum(labels.get(i) == 1 for i in gone) > 0.6 * sum(labels.values()) and sum(labels.get(i) == 0 for i in gone) <= 2


def test_line_dedup_against_brute_force(stages):
    before, after = stages["line_dedup"]
    removed = test_op1.brute([(r["doc_id"], r["text"]) for r in before])
    want = {r["doc_id"]: "\n".join(x for i, x in enumerate(r["text"].split("\n")) if i not in removed[r["doc_id"]]) for r in before}
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(before)
    assert all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_dedup_keeps_one_of_each_class(stages):
    before, after = stages["near_dedup"]
    assert sorted(ids(after)) == sorted(set(test_op9.classes([(r["doc_id"], r["text"]) for r in before]).values()))


def test_mix_takes_effect(stages):
    before, after = stages["source_mix"]
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    times = Counter(ids(after))
    assert set(times) <= set(ids(before)) and max(times.values()) == 2 and 0.9 * words(before) < words(after) < 1.1 * words(before)


def test_bpe_covers_all_rows(stages):
    before, after = stages["bpe"]
    assert Counter(ids(after)) == Counter(ids(before))


def test_run_is_the_stages(spark, stages):
    assert Counter(tuple(r) for r in C.run(spark, SF).collect()) == Counter(tuple(r.values()) for r in stages["bpe"][1])


ODD = "doc_id long, text string, lang string, source string, n_chars long, m_take string, m_l0 int, own_0 int, tox_p double, TOX_grade string, `a.b` string, k_id int, g_no int, part int"


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None), (1, "", "en", "src0", 0), (1, "", "en", "src0", 0), (2, "one line of several words here\\nand a second one", None, "src1", 40), (3, "word " * 60_000, "de", None, None)]])
def test_stages_keep_odd_columns_and_rows(spark, rows):
    more = ("m", 7, 8, 9.5, "g", "dot", 1, 2, 3)
    docs = spark.createDataFrame([(*r, *more) for r in rows], ODD)
    for name, stage in C.STAGES:
        got = C.saved(stage(spark, docs, "/root/testdata/sf0.001"), f"odd-{name}")
        if name != "bpe":
            assert got.columns == docs.columns
            assert {tuple(r)[5:] for r in got.collect()} <= {more}
            assert name not in ("toxicity", "line_dedup") or got.count() == len(rows)
            docs = got
    assert got.count() == docs.count()
