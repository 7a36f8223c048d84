"""The driver's contract: names without a session, and queries against their SQL at the smallest size."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = "/root/testdata/sf0.001"
TABLES = ("part", "lineitem", "nation")


def test_names_without_a_session():
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print('NAMES', *e.queries()); print(len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert said.returncode == 0, said.stderr
    assert "view_types_snps" in said.stdout


def test_without_the_llm_subpackage(tmp_path):
    for x in ("locusframe", "__spark_entry__.py"):
        subprocess.run(["cp", "-r", str(ROOT / x), str(tmp_path)], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "locusframe" / "llm")], check=True)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(sum(n.startswith('op') for n in e.queries()), len(e.queries()) > 40)"], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert said.stdout.split()[-2:] == ["0", "True"], said.stderr


def compare(spark, query, sql):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(v) for _, v in sorted(zip(names, r, strict=True))) for r in cur.fetchall())
    df = query(spark, DATA)
    assert sorted(df.columns) == sorted(names)
    assert sorted(tuple(str(r[n]) for n in sorted(names)) for r in df.collect()) == want
    assert want


@pytest.mark.parametrize("name", ["view_types_snps", "view_qual_bounds", "view_acan_subset", "region_coalesce", "concat_roundtrip", "merge_outer_uniform", "merge_missing_to_ref", "merge_modes_all", "merge_ad_remap", "merge_filter_union", "merge_order", "vcf_text_roundtrip", "bgzf_roundtrip", "header_union"])
def test_queries_equal_their_sql(spark, name):
    from locusframe.plans import catalog

    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
