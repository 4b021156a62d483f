import pytest

from tkanyna.llm import queries
from tkanyna.llm.truncation import is_cut
from tkanyna.llm.words import usual_form

COLUMNS = {
    "p1_found": ["sent_id_a", "sent_id_b"], "p2_found": ["tbl", "row_id"], "p3_found": ["pair_id_a", "pair_id_b"], "p4_found": ["tbl", "row_id", "field"], "p5_found": ["record_id", "defect"], "p7_found": ["doc_id", "item_id"],
    "p9_found": ["doc_id", "level"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs(name, spark, folder):
    df = queries.queries()[name](spark, folder)
    rows = df.collect()
    assert rows or name == "p2_prefix_copies"
    if name in COLUMNS:
        assert df.columns == COLUMNS[name] and len(set(rows)) == len(rows)
    if name in ("p1_found", "p3_found"):
        assert all(a < b for a, b in rows)


def test_cuts_and_usual_forms_row_by_row(spark, folder):
    pairs = spark.read.parquet(f"{folder}/parallel_pairs.parquet").collect()
    sentences = spark.read.parquet(f"{folder}/standard_ukrainian.parquet").collect()
    cut = {r.row_id for r in queries.p2_found(spark, folder).filter("tbl = 'parallel_pairs'").collect()}
    assert cut == {r.pair_id for r in pairs if is_cut(r.source, r.target)}
    odd = {(r.tbl, r.row_id, r.field) for r in queries.p4_found(spark, folder).collect()}
    assert odd == {("parallel_pairs", r.pair_id, f) for r in pairs for f in ("source", "target") if usual_form(r[f]) != r[f]} | {("standard_ukrainian", r.sent_id, "text") for r in sentences if usual_form(r.text) != r.text}


def test_levels_leave_out_rated_documents(spark, folder):
    rated = {r.doc_id for r in spark.read.parquet(f"{folder}/level_labels.parquet").collect()}
    assert not rated & {r.doc_id for r in queries.p9_found(spark, folder).collect()}
