import json

from quern.operators import nested
from quern.session import table


def leaves(kind, content):
    """Every wanted leaf by plain recursion over the parsed content."""
    out = []

    def wanted(keys):
        if kind == "manual-review":
            return keys[-1:] == ("status",) and "companies" in keys[:-1]
        if kind == "questions":
            return any(k == "values" and "goldEvidence" in keys[:i] for i, k in enumerate(keys))
        return "tableMethods" in keys

    def walk(v, path, keys):
        if isinstance(v, dict):
            for k, x in v.items():
                walk(x, f"{path}/{nested.pointer(k)}", (*keys, k))
        elif isinstance(v, list):
            for i, x in enumerate(v):
                walk(x, f"{path}/{i}", (*keys, i))
        elif v is not None and wanted(keys):
            out.append((path, nested.scalar_text(v)))

    walk(content, "", ())
    return out


def test_against_brute_force(spark, small):
    records = table(spark, small, "json_records")
    got = {(r.record_id, r.leaf_path, r.leaf_value) for r in nested.wanted_leaves(records).collect()}
    want = {(r.record_id, *x) for r in records.collect() if (c := nested.parse_body(r.body)) is not None for x in leaves(r.record_kind, c)}
    assert got == want and got


def test_odd_bodies(spark):
    deep = '{"companies":' + "[" * 30000 + "]" * 30000 + "}"
    bodies = [
        ("manifest", '﻿{"reports":[{"tableMethods":{"a/b~":1.50,"n":null,"x":[true,"y"]}}]}'),
        ("manifest", json.dumps(json.dumps({"tableMethods": {"m": 1e3}}))),
        ("questions", '{"goldEvidence":{"values":"v"},"values":1}'),
        ("manual-review", '{"companies":{"E1":{"status":"ok","inner":{"status":"s2"}}},"status":"no"}'),
        ("manual-review", '{"companies":[{"status":"a"}'), ("manual-review", None), ("manual-review", ""), ("manual-review", "null"), ("manual-review", deep), (None, '{"status":1}'),
        ("manual-review", '{"companies":[{"status":"\\ud83d"}]}'),
    ]
    df = spark.createDataFrame([(i, k, b, "clash") for i, (k, b) in enumerate(bodies)], "record_id long, record_kind string, body string, row_key string")
    got = {(r.record_id, r.leaf_path, r.leaf_value) for r in nested.wanted_leaves(df).collect()}
    assert got == {
        (0, "/reports/0/tableMethods/a~1b~0", "1.50"), (0, "/reports/0/tableMethods/x/0", "true"), (0, "/reports/0/tableMethods/x/1", "y"), (1, "/tableMethods/m", "1000.0"),
        (2, "/goldEvidence/values", "v"), (3, "/companies/E1/status", "ok"), (3, "/companies/E1/inner/status", "s2"), (10, "/companies/0/status", "�"),
    }
    assert nested.wanted_leaves(df.limit(0)).count() == 0


def test_rows_find_their_parents(spark, small):
    rows = nested.exploded(table(spark, small, "json_records"))
    keys = {r.row_key for r in rows.select("row_key").collect()}
    for r in rows.select("parent_key", "table_path").collect():
        assert (r.parent_key in keys) if r.table_path else r.parent_key is None
    schema = nested.merged_schema(table(spark, small, "json_records"))
    levels = {(r.record_kind, r.table_path): r.parent_table for r in nested.table_levels(schema).collect()}
    assert levels["questions", "/questions/[]/goldEvidence/[]"] == "/questions/[]"
    assert {(r.record_kind, r.table_path) for r in rows.select("record_kind", "table_path").distinct().collect() if r.table_path} == set(levels)


def test_companies_have_all_their_statuses(spark, small):
    from quern.plans.problems import companies

    body = {"questions": [{"companies": [{"code": "1", "status": "a", "retrieval": {"status": "b"}, "answer": {"status": "c"}, "x": {"y": {"status": "d"}}, "z": [{"status": "e"}]}]}]}
    row, deep = companies(spark.createDataFrame([(1, "manual-review", json.dumps(body))], "record_id long, record_kind string, body string")).orderBy("table_path").collect()
    assert (row.status, row.retrieval_status, row.answer_status) == ("a", "b", "c")
    assert row.statuses == {"/status": "a", "/retrieval/status": "b", "/answer/status": "c", "/x/y/status": "d"}
    assert deep.statuses == {"/status": "e"} and deep.parent_key == row.row_key
    records = table(spark, small, "json_records").where("record_kind = 'manual-review'")
    got = [v for r in companies(records).collect() for v in r.statuses.values()]
    assert sorted(got) == sorted(r.leaf_value for r in nested.wanted_leaves(records).collect()) and got


def test_no_depth_and_no_number_of_encodings_is_too_much(spark):
    body = json.dumps({"tableMethods": {"m": 3}})
    for _ in range(9):
        body = json.dumps(body)
    deep = '{"companies":' + "[" * 25000 + '{"status":"x","a":1.50}' + "]" * 25000 + "}"
    chain = '{"a":' * 12000 + '{"companies":{"b":{"c":[{"d":{"status":"y"}}]}}}' + "}" * 12000
    inner = '{"companies":' + '{"a":' * 3000 + '{"companies":{"q":{"status":"z"}}}' + "}" * 3001
    rows = [(1, "manifest", body), (2, "manual-review", deep), (3, "manual-review", chain), (4, "manual-review", inner), (5, "manual-review", deep[:-1])]
    got = {r.record_id: (r.leaf_path, r.leaf_value) for r in nested.wanted_leaves(spark.createDataFrame(rows, "record_id long, record_kind string, body string")).collect()}
    assert got == {
        1: ("/tableMethods/m", "3"), 2: ("/companies" + "/0" * 25000 + "/status", "x"), 3: ("/a" * 12000 + "/companies/b/c/0/d/status", "y"), 4: ("/companies" + "/a" * 3000 + "/companies/q/status", "z"),
    }


def test_parser_without_recursion_agrees_with_the_library():
    texts = ['{"a":[1,2.50,-3e5,{"b":null,"c":true}],"a":"x"}', "[]", "{}", '"x"', "1", '[[],{}]', '{"a":{"b":[]}}', "  [1 , 2 ] "]
    bad = ["", "[", "]", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "1 2", '{"a":1,}', "{1:2}", "[1}", "nul", '["a', "[,1]", "{}[]", '{"a":1 "b":2}']
    for t in texts:
        assert nested.parse_nested(t) == nested._DECODER.decode(t.strip())
    for t in bad:
        for parse in (nested.parse_nested, nested._DECODER.decode):
            try:
                parse(t)
            except ValueError:
                continue
            raise AssertionError(t)


def test_children_join_their_parents(spark, small):
    from quern.plans import problems

    evidence, values = problems.p6_evidence(spark, small).collect(), problems.p6_evidence_values(spark, small).collect()
    keys = {r.row_key for r in evidence}
    assert evidence and values and all(r.parent_key in keys for r in values if r.parent_table.endswith("/goldEvidence/[]"))
    leaves = [r.leaf_value for r in nested.wanted_leaves(table(spark, small, "json_records").where("record_kind = 'questions'")).collect()]
    assert len(values) <= len(leaves)
