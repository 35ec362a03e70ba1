import duckdb
import pytest

from tilewright.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["q_threshold", "q_component_stats", "q_distance_within", "q_pyramid", "q_mask", "q_group_rollup", "q_hsv", "q_best_level", "q_path", "q_text", "q_xml_roundtrip", "q_worklist_images", "q_series", "q_tile_pyramid", "q_store_about", "q_mask_tiles", "q_distance_sizes", "q_holes", "q_lut_odd", "q_nearest_slides", "q_filelist", "q_tile_function"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, sf, name):
    df = registry.queries()[name](spark, sf)
    want = duck.sql(registry.oracle_sql()[name])
    a = sorted(df.columns)
    assert a == sorted(want.columns)
    norm = lambda v: round(v, 6) if isinstance(v, float) else v
    got = sorted((tuple(norm(r[c]) for c in a) for r in df.collect()), key=repr)
    at = [want.columns.index(c) for c in a]
    assert got == sorted((tuple(norm(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_every_sql_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())
