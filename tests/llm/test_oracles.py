"""The registered queries against their oracle SQL on the small tables."""

import os

import duckdb
import pytest

from sitelume.llm import queries

AT = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_oracle(spark, name):
    c = duckdb.connect()
    for f in os.listdir(AT):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{AT}/{f}')")
    df = queries.QUERIES[name](spark, AT)
    columns = sorted(df.columns)
    res = c.execute(queries.ORACLE[name])
    names = [d[0] for d in res.description]
    assert sorted(names) == columns
    want = sorted((tuple(r[names.index(k)] for k in columns) for r in res.fetchall()), key=repr)  # some values are null
    assert sorted((tuple(r) for r in df.select(*columns).collect()), key=repr) == want


def test_pii_oracle_on_context(spark, tmp_path):
    """The oracle looks on both sides of a match, whatever stands there, as the operator does."""
    texts = [
        "Amex card, expires 09/27, number 378282246310005", "SSN list: 123-45-6789, 219-09-9999", "378282246310005 is my visa card", "378282246310005 (amex)", "card" + " " * 36 + "378282246310005",
        "card" + " " * 37 + "378282246310005", "discard" + " " * 36 + "378282246310005", "é 219-09-9999" + " " * 17 + "ssn", "é 219-09-9999" + " " * 17 + "ssns", "219-09-9999" + " " * 18 + "ssn", "écard 378282246310005",
        "DE89 3704 0044 0532 0130 00 konto", "", None, "219-09-9999,123-45-6789 Social Security",
    ]
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(at)
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/*.parquet'); {queries.ORACLE['op2_pii']}").fetchall()
    df = queries.QUERIES["op2_pii"](spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(want)
    assert sum(bool(r[-1]) for r in want) == 8


def test_quality_oracle_on_lines(spark, tmp_path, odd_texts):
    from test_documents import LINES

    texts = [*(t for t in odd_texts if len(t or "") < 100_000), *LINES, "\n".join(LINES), "word and " * 60 + "\n" + "\n".join(LINES) + "\n" + "other things. " * 40]
    at = f"{tmp_path}/documents.parquet"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(at)
    want = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/*.parquet'); {queries.ORACLE['op7_quality_rules']}").fetchall()
    assert sorted(map(tuple, queries.QUERIES["op7_quality_rules"](spark, str(tmp_path)).collect())) == sorted(want)


def test_every_operator_is_registered():
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op"))
    assert numbers == list(range(1, 14)) and "pipeline" in queries.QUERIES
