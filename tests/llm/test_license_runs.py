"""Licence notices that run over several lines or stand inside a longer one."""

import textwrap

import duckdb

from lakeload.llm import licenses


def test_runs_over_lines_and_inside_lines(spark):
    mit, texts = licenses.TEMPLATES[5][1], licenses.TEXTS
    around = " ".join(f"word{k}" for k in range(40))
    far = " ".join(f"far{k}" for k in range(300))
    rows = [
        (1, "Copyright (c) someone\n\n" + "\n".join("# " + x for x in textwrap.wrap(mit, 75)) + f"\n\n{around}"),
        (2, f"{around} Released under the MIT License. {around}"),
        (3, "\n".join(textwrap.wrap(texts[0][1], 80))),
        (4, f"{around}\n{far}\n" + "\n".join(textwrap.wrap(texts[2][1], 60)) + f"\n{around}"),
        (5, f"{around}\n{mit}\n{around}"),
        (6, "\n".join([around, *textwrap.wrap(mit, 70), around, *textwrap.wrap(mit, 40)])),
        (7, f"{around} the MIT licence or the software is not released {around}"),
        (8, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [tuple(r) for r in licenses.scan(docs).collect()]
    at = {(d, line, t) for d, line, t, _, _ in found}
    assert len(at) == len(found)
    bsd, first = len(licenses.TEMPLATES) + 2, 2 + len(textwrap.wrap(mit, 70))
    assert {x for x in at if x[0] in (1, 2)} == {(1, 3, 5), (2, 1, 3)}
    assert {(3, 0, 17), (3, 1, 5), (4, 3, bsd), (4, 3, 13)} <= at
    assert {x for x in at if x[0] == 5} == {(5, 2, 5)}  # once, as its line
    assert {x for x in at if x[0] == 6} == {(6, 2, 5), (6, first + 1, 5)}
    assert not {x for x in at if x[0] > 6}
    assert all(dice > 0.99 for d, *_, dice in found if d in (1, 2, 5, 6))


def test_given_documents_equal_sql(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    base = duckdb.connect()
    base.register("documents", spark.read.parquet(path).toArrow())
    wanted = base.execute(licenses.oracle_sql()).fetchall()
    found = [tuple(r) for r in licenses.scan(spark.read.parquet(path)).collect()]
    assert sorted(found, key=repr) == sorted(wanted, key=repr) and found
