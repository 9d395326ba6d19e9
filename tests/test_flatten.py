from leafmill.operators.flatten import child_keys, flatten_nested, levels, merged_schema, parse_records, record_child_keys
from tests.conftest import block


def keys(df):
    return sorted(tuple(r) for r in df.collect())


def brute(rows):
    out, seen = set(), set()
    for r in rows:
        if r["record_id"] in seen and r["record_id"] is not None:
            continue
        seen.add(r["record_id"])
        rid, orders = r["record_id"], {b[4] for b in r.get("blocks") or []}
        for i, b in enumerate(r.get("blocks") or []):
            out.add((rid, "block", i, -1, -1))
            if b[3] is not None:
                out.add((rid, "bbox", i, -1, -1))
        for i, t in enumerate(r.get("tables") or []):
            out.add((rid, "table", i, -1, -1))
            for j, row in enumerate(t[3] or []):
                out |= {(rid, "cell", i, j, k) for k in range(len(row or []))}
        for i, c in enumerate(r.get("chunks") or []):
            out.add((rid, "chunk", i, -1, -1))
            out |= {(rid, "link", i, j, k) for j, k in enumerate(c[2] or []) if k in orders}
    return sorted(out)


ROWS = [
    {"record_id": 1, "blocks": [block("a", order=0, bbox=[0.0, 1.0, 2.0, 3.0]), block(None, order=1), block("", order=2, bbox=[])],
     "tables": [(1, 2, 2, [["x", None], None, ["y"]], None), (1, 0, 0, None, None), (1, 0, 0, [], None)],
     "chunks": [(0, "a", [0, 2, 9, None, 0], "s", 1), (1, "b", None, "s", 1), (2, "c", [], "s", 1)]},
    {"record_id": 1, "blocks": [block("a", order=0, bbox=[0.0, 1.0, 2.0, 3.0]), block(None, order=1), block("", order=2, bbox=[])],
     "tables": [(1, 2, 2, [["x", None], None, ["y"]], None), (1, 0, 0, None, None), (1, 0, 0, [], None)],
     "chunks": [(0, "a", [0, 2, 9, None, 0], "s", 1), (1, "b", None, "s", 1), (2, "c", [], "s", 1)]},
    {"record_id": 2}, {"record_id": 3, "blocks": [], "tables": [], "chunks": []},
    {"record_id": 4, "blocks": [block("z", order=7)], "chunks": [(0, "z", [7, 0], "s", 1)]},
]


def test_child_keys_match_a_loop(records):
    assert keys(record_child_keys(records(*ROWS))) == brute(ROWS)


def test_empty_table(records, spark):
    assert keys(record_child_keys(records(*ROWS).limit(0))) == []


def test_tables_keep_links_and_rename_clashes(records):
    t = flatten_nested(records(*ROWS[:1]), "record_id", keep=["blocks.bbox"])
    assert t["blocks"].columns[:2] == ["record_id", "i"] and "bbox" in t["blocks"].columns
    cells = t["tables.cells"].select("i", "j", "k", "value").collect()
    assert sorted((r[0], r[1], r[2]) for r in cells) == [(0, 0, 0), (0, 0, 1), (0, 2, 0)]
    assert {r.value for r in cells} == {"x", None, "y"}
    assert "i" in t[""].columns  # the record's own column


def test_clashing_field(spark):
    d = spark.createDataFrame([(1, [("a", 5)])], "k INT, xs ARRAY<STRUCT<i: STRING, k: INT>>")
    t = flatten_nested(d, "k")["xs"]
    assert t.columns == ["k", "i", "xs_i", "xs_k"] and tuple(t.head()) == (1, 0, "a", 5)


def test_merged_schema_and_any_depth(spark):
    j = spark.createDataFrame([('{"id":1,"a":[{"b":[{"c":[1,2]}]}]}',), ('{"id":2,"x":{"y":["p"]}}',), (None,), ("no json",)], "t STRING")
    s = merged_schema(j, "t")
    r = parse_records(j, "t", s).filter("record.id IS NOT NULL").select("record.*")
    t = flatten_nested(r, "id")
    assert set(t) == {"", "a", "a.b", "a.b.c", "x.y"}
    assert sorted(tuple(x) for x in t["a.b.c"].collect()) == [(1, 0, 0, 0, 1), (1, 0, 0, 1, 2)]
    assert [x.name for x in levels(r.schema)] == ["a", "a.b", "a.b.c", "x.y"]
    assert merged_schema(j.limit(0), "t").fields == []


def test_null_key_keeps_its_rows(records):
    assert len(keys(record_child_keys(records({"blocks": [block("a")]}, {"blocks": [block("a")]})).select("child", "i"))) == 2


def test_long_record(records):
    n = 3000
    r = {"record_id": 1, "blocks": [block("w" * 50, order=i) for i in range(n)], "chunks": [(0, "t", list(range(n)), "s", 1)]}
    assert record_child_keys(records(r)).count() == 2 * n + 1


def test_child_keys_by_name(spark):
    d = spark.createDataFrame([(1, [(["a", "b"],)])], "id INT, t ARRAY<STRUCT<u: ARRAY<STRING>>>")
    assert keys(child_keys(d, "id", {"t.u": "u"})) == [(1, "u", 0, 0, -1), (1, "u", 0, 1, -1)]
