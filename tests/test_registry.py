import importlib
import os
import sys

import pytest

from siteseer.plans import catalog

SF = "/root/testdata/sf0.001"


def test_every_query_has_an_oracle():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", ["site_extract", "search_mixed", "profile_positions", "annotate_multi_track", "snp_dictionary", "logo_by_guide", "profile_extended_file", "fasta_files", "merged_hits", "vcf_scan", "cfd_gate"])
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "labels", "events"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, SF)
    want = con.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    a = sorted(repr(tuple(show(x) for x in r)) for r in got.select(*names).collect())
    b = sorted(repr(tuple(show(x) for x in r)) for r in want.fetchall())
    assert a == b


def test_entry_without_the_optional_package(monkeypatch):
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    sys.modules.pop("__spark_entry__", None)
    e = importlib.import_module("__spark_entry__")
    assert "search_mm" in e.queries() and not any(k.startswith("op1_") for k in e.queries())
    sys.modules.pop("__spark_entry__", None)
