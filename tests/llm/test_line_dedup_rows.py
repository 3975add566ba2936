"""Rows with one doc_id and different texts."""

from test_llm_operators import frame

from loomstead.llm import line_dedup


def test_rows_of_one_id_lose_their_own_lines_alone(spark):
    rows = [(1, "a line that is shared\nend"), (2, "a line that is shared\nx"), (2, "a line of its own\nanother of its own"), (2, None)]
    out = sorted((r.doc_id, r.text) for r in line_dedup.dedup_lines(frame(spark, rows)).collect())
    assert out == [(1, "a line that is shared\nend"), (2, ""), (2, "a line of its own\nanother of its own"), (2, "x")]
