"""Every dealt query on empty tables, awkward rows and extra columns."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from ridgeline.llm.registry import ORACLE, QUERIES

from oracle_check import compare, duck
from ridgeline.llm import common, linededup, mixing, paritysketch, quality

LABELS = [(7, 1, 0), (8, 1, 0), (9, 0, 0), (10, 1, 1), (5, None, 0), (None, 1, 1), (6, 1, 0), (6, 1, 0)]
BENCHMARK = [(0, "alder1"), (1, None), (2, ""), (None, "other text with the same id"), (3, "other text with the same id"), (4, "one two three four")]
CONVERSATIONS = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", "again"), (None, 0, "user", "x"), (2, None, "system", ""),
                 (3, 0, None, "a <b> \"c\" \\ \n é"), (3, 0, None, "a <b> \"c\" \\ \n é"), (4, 5, "user", "</tool_call> alone"),
                 (6, None, "user", "no turn"), (6, None, "assistant", "no turn either")]
CLASHING = {"_text_key": "a", "slot": "b", "shard": "c", "n": "d", "class": "e", "kept": "f", "draws": "g", "_key0": "h", "row": "i", "words": "j", "gone": "k"}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("name", [*QUERIES, "pipeline"])
def test_empty_tables(spark, tables, name):
    assert E.queries()[name](spark, tables()).count() == 0


@pytest.mark.parametrize("name", [n for n in QUERIES if not n.startswith(("op9_", "op11_", "op12_"))])
def test_awkward_rows_and_clashing_columns(spark, tables, awkward, name):
    plain = rows(E.queries()[name](spark, tables(documents=awkward, labels=LABELS, benchmark=BENCHMARK)))
    assert len(plain) == len(awkward)  # a row per document, repeated ones included
    more = rows(E.queries()[name](spark, tables(extra=CLASHING, documents=awkward, labels=LABELS, benchmark=BENCHMARK)))
    assert [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in plain] == [tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in more]


def test_awkward_conversations(spark, tables):
    out = E.queries()["op9_tool_links"](spark, tables(conversations=CONVERSATIONS)).collect()
    assert len(out) == len(CONVERSATIONS) + 1  # the result of conversation 6 stands behind a text
    assert {r.order_rank for r in out if r.turn is None} == {0}
    by = {(r.conv_id, r.turn, r.kind): r for r in out}
    assert by[(1, 0, "call")].linked and by[(3, 0, "text")].json == '{"content":"a <b> \\"c\\" \\\\ \\n é","type":"text"}'
    assert sorted(r.problem or "" for r in out if r.conv_id == 1) == ["", "", "repeated result"]
    assert by[(4, 5, "call")].problem == "no result"
    again = E.queries()["op9_tool_links"](spark, tables(extra=CLASHING, conversations=CONVERSATIONS)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, sf_small, name):
    ok, msg = compare(spark, duck(sf_small), name, E.queries()[name], E.oracle_sql()[name], sf_small)
    assert ok, msg


def test_pipeline_on_awkward_rows_keeps_one_of_each(spark, tables, awkward):
    folder = tables(extra=CLASHING, documents=awkward + [(20, "b " * 400), (21, awkward[6][1] + " end")], labels=LABELS, benchmark=BENCHMARK)
    out = E.queries()["pipeline"](spark, folder).collect()
    kept = [r.doc_id for r in out]
    assert 7 in kept and 6 in kept and not {8, 9, 20, 21, 1, 2, 3, 4, None} & set(kept)
    assert len(kept) == len(set(kept))


def test_stages_return_the_columns_of_documents(spark, tables, awkward):
    import corpus_pipeline as P

    folder = tables(extra=CLASHING, documents=awkward, labels=LABELS, benchmark=BENCHMARK)
    docs = common.table(spark, folder, "documents")
    for _, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        assert {r["_text_key"] for r in out.select("_text_key").collect()} <= {"a"}


def test_no_labels_means_base_rules_and_rate_one(spark, tables, awkward):
    folder = tables(documents=awkward)
    docs, labels = common.table(spark, folder, "documents"), common.table(spark, folder, "labels")
    verdicts = quality.quality_verdicts(docs, labels).collect()
    assert all(r.kept == (not r.base_failed) for r in verdicts)
    assert {r.rate for r in mixing.mix(docs, labels, mixing.TARGETS).collect()} == {1.0}
    assert paritysketch.keep_one(docs).filter("doc_id in (7, 8, 9)").count() == 1


def test_keep_one_of_near_copies_without_ids(spark, tables):
    text = " ".join(f"word{i}" for i in range(100))
    near = [(None, text + f" end{k}") for k in range(4)]
    other = [(None, "quite another text of seven words"), (3, text.replace("word", "x")), (None, text.replace("word", "x") + " end")]
    docs = common.table(spark, tables(documents=near + other), "documents")
    kept = [(r.doc_id, r.text) for r in paritysketch.keep_one(docs).collect()]
    assert len(kept) == 3 and len(set(kept) & set(near)) == 1 and other[1] in kept and other[0] in kept
    assert {r.doc_id for r in paritysketch.near_duplicates(docs).select("component.doc_id").collect()} == {None, 3}


def test_texts_of_one_or_two_lines_are_windows(spark, tables):
    texts = ["one line", "one line", "a\nb", "a\nb", "a\nb\nc", "x\na\nb\nc", " \n", " \n", None]
    folder = tables(documents=list(enumerate(texts)))
    out = linededup.drop_repeats(common.table(spark, folder, "documents")).collect()
    gone = {r.doc_id: (r.n_lines, r.n_gone) for r in E.queries()["op3_line_windows"](spark, folder).collect()}
    assert gone == {r.doc_id: (r.n_lines, r.n_gone) for r in out}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet')")
    ok, msg = compare(spark, con, "op3_line_windows", E.queries()["op3_line_windows"], E.oracle_sql()["op3_line_windows"], folder)
    assert ok, msg
    assert {r.doc_id: (r.text, r.n_lines, r.n_gone) for r in out} == {
        0: ("one line", 1, 0), 1: ("", 1, 1), 2: ("a\nb", 2, 0), 3: ("", 2, 2), 4: ("a\nb\nc", 3, 0), 5: ("x", 4, 3),
        6: (" \n", 2, 0), 7: (" \n", 2, 0), 8: (None, 0, 0)}
