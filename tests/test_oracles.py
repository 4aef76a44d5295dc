"""Graph queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

from graphweft.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "part orders lineitem supplier".split()
SOME = ["edges_symmetrize", "csc_canonical", "csc_indptr", "degree_stats", "nc_score_ginex", "symmetry_violations", "id_compaction", "reordered_edges", "partition_quality", "partition_summary_json", "intra_range_equiv", "subsample_nodes", "keep_inter_subsampled", "inter_coin_edges", "seed_order_grouped", "neighbors_khop_edges", "neighbors_rtintra", "neighbors_replace", "intra_vs_rtintra_diff", "cached_gather", "access_percentiles", "gcn_propagate", "ckpt_eval", "synthetic_features_split", "source_text_edges", "header_checks", "sink_splits", "sink_graph_edges", "sink_intra", "offset_checks", "partition_cover", "epoch_bundle", "gat_two_heads", "stored_adjacency", "cache_degree_fill", "keep_inter_static", "source_csc", "sink_csc", "sink_csc_self_loops", "source_npz_edges", "source_npz_nodes", "growing_edges", "growing_degrees", "sql_same_part_neighbours", "sql_degrees_by_split", "sql_draws"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(tuple("" if v is None else round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert normal(map(tuple, df.select(*columns).collect())) == normal(expected)
