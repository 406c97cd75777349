"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import datetime
import decimal
import hashlib
import time

import duckdb
import pytest

from sparkfolio.functions import numbers, text
from sparkfolio.operators import documents, grids, metering, repair, rewrites, trees
from sparkfolio.plans import queries as plans
from sparkfolio.sources import files
from sparkfolio.streaming import usage

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_rows(spark, duck, name):
    df = plans.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    cursor = duck.execute(plans.SQL[name])
    theirs = [x[0] for x in cursor.description]
    assert sorted(theirs) == columns
    assert ours == sorted(tuple(plain(r[theirs.index(c)]) for c in columns) for r in cursor.fetchall())


def test_flatten_walks_any_depth(spark):
    tree = '{"type":"PART","title":"a","children":[{"type":"S","title":"b","children":[{"type":"T","title":"c"}]},{"type":"S","title":"d"}]}'
    rows = trees.flatten(spark.createDataFrame([(1, tree), (2, None)], "document_id long, hierarchy string")).orderBy("position").collect()
    assert [(r.title, r.depth, r.sequence_no, r.parent_id) for r in rows] == [("a", 0, 0, None), ("b", 1, 0, "1:0"), ("c", 2, 0, "1:1"), ("d", 1, 1, "1:0")]


def test_forward_mapper_reasons(spark):
    nodes = spark.createDataFrame([(1, 0, "a", "Big  Title", 1), (1, 1, "b", "gone", 1), (1, 2, "c", "x", 9), (1, 3, "d", "big title", 1), (1, 4, "e", "x", None)], "document_id long, position int, node_id string, title string, page_hint int")
    pages = spark.createDataFrame([(1, 1, "the big\ntitle here")], "document_id long, page_number int, text string")
    got = {r.node_id: (r.offset, r.reason) for r in trees.map_pages_forward(nodes, pages).collect()}
    assert got == {"a": (4, None), "b": (None, "not_found"), "c": (None, "out_of_range"), "d": (None, "not_found"), "e": (None, "no_hint")}


def test_cost_examples(spark):
    rows = spark.createDataFrame([("gpt-6.1-sol", 8000, 1000, 2000), ("gpt-6.1-sol", 300000, 0, 2000), ("none", 1, 0, 1)], "m string, i long, k long, o long")
    got = [r.c for r in rows.select(numbers.token_cost(*(rows[c] for c in "miko")).alias("c")).collect()]
    assert [None if x is None else float(x) for x in got] == [0.0341, 1.23, None]


def test_month_clamps(spark):
    got = spark.sql("SELECT TIMESTAMP '2026-01-31' AS t").select(numbers.next_month(text.F.col("t")).alias("t")).first().t
    assert got == datetime.datetime(2026, 2, 28)


def test_text_keys(spark):
    row = spark.sql("SELECT 'Section 12.(A) ' AS a, '12.' AS n, ' (1) A. ' AS c").select(text.base_key(text.F.col("a")).alias("a"), text.same_number(text.F.col("n")).alias("n"), text.child_key(text.F.col("c")).alias("c")).first()
    assert tuple(row) == ("12a", "12", "(1)a")


def test_windows_keep_short_tails(spark):
    rows = spark.createDataFrame([(1, " ".join(map(str, range(450)))), (2, ""), (3, None)], "k int, text string")
    got = [(r.chunk_number, r.start, r.token_count) for r in documents.token_windows(rows, "k").orderBy("chunk_number").collect()]
    assert got == [(1, 0, 450), (2, 400, 50)]
    with pytest.raises(ValueError):
        documents.token_windows(rows, "k", 100, 100)


def test_rewrites_on_empty_tables(spark):
    empty = spark.createDataFrame([], "k int, v int")
    one = spark.createDataFrame([(1, 2), (1, 2)], "k int, v int")
    assert rewrites.insert_absent(empty, one, ["k"]).count() == 1
    assert rewrites.upsert(empty, one, ["k"], "v").count() == 1


def test_lines_start_from_their_first_word(spark):
    df = spark.createDataFrame([([10.0, 12.0, 14.0, 30.0],)], "t array<double>")
    assert df.select(grids.lines_of_words(df.t)).first()[0] == [1, 1, 2, 3]


def test_matrix_problems_by_kind(spark):
    head = "document_id int, position int, table_id string, title string, start_page int, end_page int, column_count int, "
    profile = spark.createDataFrame([(1, 0, "t", "T", 2, 3, 2, 2), (1, 1, "u", "U", 2, 3, 1, 1), (2, 0, "v", None, 1, 1, 1, 0)], head + "data_row_count int")
    given = [(1, 0, "t", "other", 2, 3, 2, ["a", "b"], 2, [(1, ["x", "y"], [2]), (3, ["x"], [4]), (3, ["x", "y"], [])]), (2, 0, "v", None, 1, 1, 1, ["a"], 0, None), (3, 0, "w", "W", 1, 1, 1, ["a"], 0, [])]
    rows = spark.createDataFrame(given, head + "columns array<string>, row_count int, rows array<struct<row_number int, cells array<string>, source_pages array<int>>>")
    got = {(r.document_id, r.position, r.problem) for r in grids.matrix_problems(profile, rows).collect()}
    first = {"title", "row_count", "row 2: number", "row 2: cells", "row 2: pages outside", "row 3: no pages"}
    assert got == {(1, 0, p) for p in first} | {(1, 1, "missing"), (3, 0, "unexpected")}


def test_labels_follow_first_sight(spark):
    rows = spark.createDataFrame([(1, 1, "a", ["p", "q"]), (1, 2, "b", ["p"]), (1, 3, "a", ["p"]), (1, 4, "a", [])], "r int, i int, d string, p array<string>")
    got = [tuple(r)[2:] for r in documents.context_labels(rows, "r", "i", "d", "p").orderBy("i").collect()]
    assert got == [("E1", "D1", "H2", "H1"), ("E2", "D2", "H3", None), ("E3", "D1", "H1", None), ("E4", "D1", None, None)]


def test_a_pass_counts_only_without_a_live_subscription(spark):
    day = lambda n: datetime.datetime(2024, 1, n)
    a = spark.createDataFrame([(1, None, "none", True), (2, "s", "active", True), (3, "s", "canceled", True), (4, None, "none", False)], "user_id int, subscription_id string, subscription_status string, cancel_at_period_end boolean")
    passes = spark.createDataFrame([(u, "paid", day(1), day(9)) for u in (1, 2, 3)] + [(3, "paid", day(2), day(20)), (4, "review", day(1), day(30))], "user_id int, status string, period_start timestamp, period_end timestamp")
    periods = spark.createDataFrame([(2, "s", day(1), day(5)), (2, "s", day(5), day(8))], "user_id int, subscription_id string, period_start timestamp, period_end timestamp")
    got = [tuple(r) for r in metering.billing_status(a, passes, periods, day(10)).orderBy("user_id").collect()]
    assert got == [(1, "pass_expired", "fpx", False, day(9), False), (2, "active", "subscription", True, day(8), False), (3, "pass_active", "fpx", False, day(20), False), (4, "none", "subscription", False, None, True)]


def test_standalone_tables_need_one_container(spark):
    nodes = spark.createDataFrame([(1, "a", None, "PART", 0, 0, 1, None, 9), (1, "b", "a", "SECTION", 1, 0, 4, 7, 5), (1, "c", "a", "SECTION", 1, 1, 4, 9, 5)], "document_id int, node_id string, parent_id string, node_type string, depth int, sequence_no int, start_page int, start_character int, end_page int")
    given = spark.createDataFrame([(1, "t", 2, 3), (1, "u", 4, 5), (1, "v", 9, 10)], "document_id int, table_id string, start_page int, end_page int")
    rows, problems = grids.with_standalone_tables(nodes, given)
    assert sorted((r.node_id, r.parent_id, r.depth, r.sequence_no) for r in rows.collect() if r.parent_id) == [("1:t:2:3", "a", 1, 0), ("b", "a", 1, 1), ("c", "a", 1, 2)]
    assert sorted((r.table_id, r.containers) for r in problems.collect()) == [("u", 2), ("v", 0)]


def test_base_key_strips_only_a_leading_kind(spark):
    row = spark.sql("SELECT ' PART XII' AS a, 'PART XII' AS b").select(text.base_key(text.F.col("a")).alias("a"), text.base_key(text.F.col("b")).alias("b")).first()
    assert tuple(row) == ("partxii", "xii")


def test_trees_outlive_cycles(spark):
    nodes = spark.createDataFrame([("a", None, 0, "A"), ("b", "a", 0, "B"), ("x", "y", 0, "X"), ("y", "x", 0, "Y")], "node_id string, parent_id string, sequence_no int, title string")
    assert {r.node_id for r in trees.unreachable(nodes).collect()} == {"x", "y"}
    got = {(r.ancestor_id, r.node_id) for r in trees.closure(nodes, "title").collect()}
    assert got == {("a", "a"), ("a", "b"), ("b", "b"), ("x", "x"), ("x", "y"), ("y", "y"), ("y", "x")}


def test_numbers_follow_the_whole_order(spark):
    rows = trees.numbered(spark.range(0, 5000, 1, 7).selectExpr("(id * 7919) % 5000 AS k"), ["k"], "place").collect()
    assert len(rows) == 5000 and all(r.place == r.k + 1 for r in rows)


def test_repair_stops_and_never_trades_a_sound_entry(spark):
    shape = "document_id long, node_id string, parent_id string, sequence_no int, node_type string, identifier string, title string, start_page int"
    nodes = spark.createDataFrame([(d, n, None, i, "PART", n, n, p) for d in (1, 2) for i, (n, p) in enumerate([("a", 9), ("b", 1)])], shape)
    none = spark.createDataFrame([], "document_id long, candidate_id string, parent_id string, insert_index int, entry string, node_type string")
    nothing = spark.createDataFrame([], "document_id long, candidate_id string, entry string, node_type string, identifier string, title string, start_page int")
    # a fails above page 5; in document 2 every node fails whose neighbour was renamed
    renamed = lambda t: t.filter("title = 'bad'").select("document_id")
    validate = lambda t: (t.filter("start_page > 5").select("document_id", "node_id").unionByName(t.filter("node_id = 'b'").join(renamed(t), "document_id", "left_semi").select("document_id", "node_id")), none)
    request = lambda t, failures, missing, attempt: (failures.selectExpr("document_id", "node_id", "node_id AS identifier", "CASE WHEN document_id = 2 THEN 'bad' ELSE 'good' END AS title", "1 AS start_page"), nothing)
    out, history = repair.repaired(nodes, validate, request, 2)
    assert {(r.document_id, r.title, r.start_page) for r in out.filter("node_id = 'a'").collect()} == {(1, "good", 1), (2, "a", 9)}
    assert sorted(tuple(r) for r in history.collect()) == [(1, 1, True, None), (2, 1, False, "new_failure"), (2, 2, False, "new_failure")]
    with pytest.raises(ValueError):
        repair.repaired(nodes, validate, request, -1)


def test_files_and_captures(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.PDF").write_bytes(b"%PDF-1.7 body")
    (tmp_path / "y.pdf").write_bytes(b"")
    (tmp_path / "z.txt").write_bytes(b"no")
    got = {r.filename: (r.size, r.file_hash, r.head) for r in files.files(spark, str(tmp_path)).collect()}
    digest = lambda b: hashlib.sha256(b).hexdigest()
    assert got == {"x.PDF": (13, digest(b"%PDF-1.7 body"), "%PDF-1.7")}  # the reader leaves empty files out
    rows = spark.sql("SELECT 'é\"' AS answer, TIMESTAMP '2026-01-02 03:04:05' AS started_at")
    for _ in range(2):
        files.write_captures(rows, str(tmp_path / "captures"), "started_at")
    assert [p.name for p in (tmp_path / "captures").iterdir() if p.is_dir()] == ["_day=2026-01-02"]
    assert [tuple(r) for r in files.read_captures(spark, str(tmp_path / "captures"), "answer string, started_at timestamp").collect()] == [tuple(rows.first())] * 2


def test_holds_of_many_reservations_take_no_call_each(spark, duck, tmp_path):
    made = "SELECT (i // 4)::BIGINT AS l_orderkey, i * 7919 % 20011 AS l_partkey, (1 + i * 31 % 7)::INTEGER AS l_linenumber FROM range(1200000) t(i)"
    duck.execute(f"COPY ({made}) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    began = time.time()
    ours = plans.QUERIES["stream_holds"](spark, str(tmp_path)).groupBy("state").agg(text.F.count("*").alias("n"), text.F.sum("reservation_id").alias("s")).collect()
    assert time.time() - began < 40
    theirs = duck.execute(f"WITH lineitem AS ({made}) SELECT state, count(*), sum(reservation_id)::BIGINT FROM ({plans.SQL['stream_holds']}) GROUP BY 1").fetchall()
    assert sorted(map(tuple, ours)) == sorted(theirs)


def test_holds_go_on_from_earlier_batches(spark, tmp_path):
    shape, folder = "reservation_id long, seq int, event string", str(tmp_path / "in")
    batches = [
        [(1, 1, "held"), (2, 1, "completed"), (3, 1, "held"), (3, 2, "error"), (4, 2, "held"), (4, 1, "completed"), (5, None, "missing"), (5, 3, "held"), (6, 1, "ping")],
        [(1, 9, "completed"), (2, 5, "held"), (3, 3, "completed"), (4, 0, "held"), (None, 1, "held")],
        [(1, 2, "rejected"), (2, 1, "rejected"), (6, 2, "completed"), (None, 2, "completed")],
    ]
    for rows in batches:
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(1.1)  # files are taken by age
    read = lambda at: spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(at)
    got = {r.reservation_id: r.state for r in usage.holds(read(folder), "test").collect()}
    assert got == {1: "settled", 2: "released", 3: "uncertain", 4: "held", 5: "uncertain", None: "settled"}
    (tmp_path / "none").mkdir()
    assert usage.holds(read(str(tmp_path / "none")), "test").collect() == []


def test_bounds_have_the_types_of_their_sql_in_any_zone(spark, duck):
    theirs = duck.execute(plans.SQL["reservation_bounds"])
    columns = [x[0] for x in theirs.description]
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        df = plans.QUERIES["reservation_bounds"](spark, FOLDER).select(*columns)
        assert sorted(map(tuple, df.collect())) == sorted(theirs.fetchall())
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [kind for _, kind in df.dtypes] == ["bigint"] * 4  # as DuckDB describes them
