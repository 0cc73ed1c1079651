from __future__ import annotations

import os

import duckdb
import pytest

from pageweave.plans import registry

CHECKED = (
    "m10_evaluate_losses", "m1_component_means", "m9_self_intersection", "w5_answer_counts", "w5_answer_items", "w14_usage_so_far", "w15_call_costs",
    "w2_request_bodies", "w18_contour_proposals", "g2_contours_to_retina", "g18_boxed_mask", "g14_contour_points", "g9_cascade_params", "g11_lifted_contours",
    "h8_unknown_characters", "t14_annotation_status", "c14_extracted_pages", "s10_pdf_page_names", "t10_draw", "t3_teacher_forced_items", "w1_claims_appended",
    "s8_registry_snapshots", "w4_chunk_requests", "w9_store_over_existing", "d2_resumed_cascade", "h9_inherit_flag", "s3_bad_files",
)


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", CHECKED)
def test_queries_match_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    df = registry.queries()[name](spark, sf)
    got = con.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr([plain(r[c]) for c in cols]) for r in df.collect()) == sorted(repr([plain(v) for v in r]) for r in got.fetchall())


def test_every_sql_has_its_query():
    assert len(registry.queries()) > 150 and set(registry.oracle_sql()) <= set(registry.queries())
