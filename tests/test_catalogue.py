import pytest
from compare import connect, same

from pairloom.plans import catalogue


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_equals_its_sql(spark, sf_dir, con, name):
    same(catalogue.QUERIES[name](spark, sf_dir).toPandas(), con.sql(catalogue.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 2
    assert set(e.oracle_sql()) <= set(e.queries())


def test_control_numbers(spark, sf_dir):
    from pairloom.plans import clips

    enroll, test = clips.sides(spark, sf_dir)
    assert (enroll.count(), test.count(), clips.positives(spark, sf_dir).count(), clips.negatives(spark, sf_dir).count()) == (107, 223, 2586, 8644)


def test_signals_against_numpy(spark, sf_dir):
    import numpy as np

    from pairloom.functions import vectors

    curve = vectors.calibration()
    assert len(curve) == len(vectors.SNR_GRID_DB) and all(a <= b for a, b in zip(curve, curve[1:]))
    got = {r["vec_id"]: r for r in catalogue.wada_snr(spark, sf_dir).collect()}
    for r in catalogue.table(spark, sf_dir, "embeddings").limit(40).collect():
        x = np.abs(np.array(r["embedding"], np.float64)) + 1e-10
        g = min(max(np.log(x.mean()) - np.log(x).mean(), curve[0]), curve[-1])
        assert got[r["vec_id"]]["wada_snr_db"] == pytest.approx(np.interp(g, curve, vectors.SNR_GRID_DB), abs=1e-6) or g in (curve[0], curve[-1])


def test_batches_keep_their_rules(spark, sf_dir):
    from pairloom.operators import batching

    b = catalogue.length_sorted_batches(spark, sf_dir).toPandas()
    assert len(b) == b.clip_id.nunique() == 500
    for _, part in b.groupby(["shard", "batch"]):
        assert len(part) <= 16 and (len(part) == 1 or len(part) * part.duration_cs.max() <= 24_000)
    waste = batching.padding_waste(catalogue.length_sorted_batches(spark, sf_dir)).first()
    assert waste["clips"] == 500 and 0 <= waste["waste_percent"] < 30
