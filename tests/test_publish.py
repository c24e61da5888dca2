"""Saved designs: versions of which readers see a whole one, digests, look-ups that skip row groups; cones of all call sites."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_design import small
from wirespan.operators import closure, verify, views
from wirespan.sources import integrity, publish, schema
from wirespan.sources.design import Design, IntegrityError


def status(design):
    return design["meta"].where("key = 'analysis_status'").first().value


def version_of(spark, state):
    rows = [(k, state if k == "analysis_status" else v) for k, v in [("schema_version", "14"), ("analysis_status", "")]]
    return small(spark, meta=rows)


class Killed(Exception):
    pass


STEPS = ["net", "tree_node", "manifest", "before the number", "with an empty number"]


@pytest.mark.parametrize("step", STEPS)
def test_a_writer_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch, step):
    path = f"file://{tmp_path}/d"
    assert version_of(spark, "old").save(path, manifest=False) == 1
    new = version_of(spark, "new")

    def die(*_, **__):
        raise Killed

    if step in schema.TABLES:
        new._make = dict(new._make) | {step: die}
    elif step == "manifest":
        monkeypatch.setattr(integrity, "digests", die)
    elif step == "before the number":
        monkeypatch.setattr(publish, "publish", die)
    else:
        def half(spark, path, version, tries=1):
            folder = publish._Folder(spark, path)
            folder.files.create(folder.at("published", f"{2:010d}"), False).close()
            raise Killed

        monkeypatch.setattr(publish, "publish", half)
    with pytest.raises(Killed):
        new.save(path)
    monkeypatch.undo()
    assert status(Design.load(spark, path)) == "old"
    assert version_of(spark, "newer").save(path, manifest=False) == (3 if step == STEPS[-1] else 2)
    assert status(Design.load(spark, path)) == "newer"


def test_numbers_are_taken_once_and_old_versions_swept(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    for state in ("one", "two", "three"):
        version_of(spark, state).save(path, manifest=False)
    spark.range(1).write.parquet(f"{publish.new_version(path)}/net")  # of a writer that died
    assert publish.sweep(spark, path, keep=3) == []  # it may be at work still
    gone = publish.sweep(spark, path, keep=2, older_than_ms=0)
    assert len(gone) == 2 and status(Design.load(spark, path)) == "three"


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    """Another writer takes the next number between the listing and the creation."""
    path = f"file://{tmp_path}/d"
    version_of(spark, "one").save(path, manifest=False)
    plain = publish._Folder.names
    monkeypatch.setattr(publish._Folder, "names", lambda self, *parts: [] if parts == ("published",) else plain(self, *parts))
    assert publish.publish(spark, path, "versions/none") == 2


def test_no_version_is_no_design(spark, tmp_path):
    assert publish.current(spark, f"file://{tmp_path}/none") is None


# --- integrity ---------------------------------------------------------------------------------
def test_changed_lost_and_doubled_rows_are_told(spark, tmp_path):
    good = small(spark)
    recorded = spark.createDataFrame(integrity.digests(good).collect(), integrity.MANIFEST)
    told = lambda table, df: [(r.table_name, r.problem) for r in integrity.problems(recorded, {t: df if t == table else good[t] for t in schema.TABLES}).collect()]
    net = good["net"]
    assert told("net", net) == [] and told("net", net.repartition(5).orderBy(F.desc("id"))) == []
    assert told("net", net.where("id > 1")) == [("net", "rows")]
    assert told("net", net.union(net.where("id = 1"))) == [("net", "rows")]
    assert told("net", net.where("id > 1").union(net.where("id = 2"))) == [("net", "content")]
    assert told("net", net.withColumn("name", F.when(F.col("id") == 1, "other").otherwise(F.col("name")))) == [("net", "content")]
    assert told("net", net.withColumn("line", F.when(F.col("id") == 1, 0).otherwise(F.col("line")).cast("long"))) == [("net", "content")]
    assert [(r.table_name, r.problem) for r in integrity.problems(recorded.where("table_name <> 'net'"), good).collect()] == [("net", "missing")]


def test_load_checks_the_manifest(spark, tmp_path):
    path = f"file://{tmp_path}/d"
    small(spark).save(path)
    Design.load(spark, path, check=True)
    where = publish.current(spark, path)
    small(spark)["term"].limit(1).write.mode("append").parquet(f"{where}/term")
    with pytest.raises(IntegrityError, match="term: rows, 3 for 2"):
        Design.load(spark, path, check=True)


# --- look-ups ----------------------------------------------------------------------------------
def rows_read(spark, df):
    """Rows that the scans of an executed query gave."""
    df.collect()
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStageExec"):
            todo.append(node.plan())
            continue
        if name == "FileSourceScanExec":
            found.append((node.relation().location().rootPaths().head().getName(), node.metrics().apply("numOutputRows").value()))
        children = node.children()
        todo.extend(children.apply(k) for k in range(children.size()))
    return found


def test_forward_look_ups_skip_row_groups(spark, tmp_path):
    """Of 40 000 dependencies in small row groups, sorted by target, those from one source are read without the rest; so are statements'."""
    n = 40_000
    deps = spark.range(1, n + 1).select(
        "id", *(F.lit(None).cast(f.dataType).alias(f.name) if f.name not in ("src_net_id", "tgt_net_id", "stmt_id", "dep_kind") else {"src_net_id": F.pmod(F.xxhash64("id"), F.lit(5000)) * 2, "tgt_net_id": F.col("id"), "stmt_id": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(9000)) * 2, "dep_kind": F.lit("data")}[f.name].alias(f.name) for f in schema.TABLES["net_dep"].fields if f.name != "id"))
    path = f"file://{tmp_path}/d"
    design = small(spark)
    nets = spark.range(0, n + 1).select("id", *(F.lit({"inst_id": 1, "scope_node_id": 1, "is_implicit": 0, "name": "n", "decl_kind": "wire"}.get(f.name)).cast(f.dataType).alias(f.name) for f in schema.TABLES["net"].fields if f.name != "id"))
    design._make = dict(design._make) | {"net_dep": lambda: deps.select(*schema.TABLES["net_dep"].names), "net": lambda: nets.select(*schema.TABLES["net"].names)}
    design.save(path, manifest=False, row_group_bytes=32_768)
    stored = Design.load(spark, path)
    of = lambda column, value: stored["net_dep"].where(F.col(column) == value)
    for column in ("src_net_id", "stmt_id"):
        some = deps.where("id = 77").select(column).first()[0]
        (name, read), = rows_read(spark, of(column, some))
        assert name == "net_dep" and 0 < read < n / 2, (column, read)
        (_, none), = rows_read(spark, of(column, some + 1))  # an odd id is in no row group
        assert none < n / 10, (column, none)
    some = deps.where("id = 77").select("src_net_id").first()[0]
    reads = rows_read(spark, views.load(stored).where(F.col("signal_net_id") == some))
    assert max(x for name, x in reads if name == "net_dep") < n


# --- call sites --------------------------------------------------------------------------------
def test_cones_of_all_sites_equal_one_by_one(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(40), rng.randrange(40), rng.choice([None, None, 1, 2, 3])) for _ in range(90)]
    e = spark.createDataFrame([*edges, (None, 1, 1), (1, None, 2)], "src long, dst long, site long")
    seeds = [(n, s) for n in range(0, 40, 7) for s in (1, 2, 3)]
    got = {(r.seed, r.site, r.node): r.depth for r in closure.reached_by_site(e, spark.createDataFrame([(n, s, n) for n, s in seeds], "seed long, site long, node long")).collect()}
    expected = {}
    for s in (1, 2, 3):
        own = e.where((F.col("site").isNull()) | (F.col("site") == s)).select("src", "dst")
        for r in closure.reached(own, spark.createDataFrame([(n, n) for n, x in seeds if x == s], "seed long, node long")).collect():
            expected[(r.seed, s, r.node)] = r.depth
    assert got == expected


def test_the_first_edge_with_a_site_binds_it(spark):
    e = spark.createDataFrame([(1, 2, None), (2, 3, 7), (2, 4, 8), (3, 5, 8), (3, 6, None), (4, 6, 8), (6, 9, 7)], "src long, dst long, site long")
    got = {(r.site, r.node) for r in closure.reached_by_site(e, spark.createDataFrame([(1, None, 1)], "seed long, site long, node long")).collect()}
    assert got == {(None, 1), (None, 2), (7, 3), (8, 4), (7, 6), (8, 6), (7, 9)}


# --- references --------------------------------------------------------------------------------
def test_references_are_distinct_before_they_are_looked_up(spark):
    """Of a file that all rows name, the anti join sees one row."""
    design = small(spark)
    from tests.test_design import row

    many = [row("net", id=k, inst_id=1, scope_node_id=1, name=f"n{k}", decl_kind="wire", is_implicit=0, file_id=1 if k % 50 else 99, line=1, col=1) for k in range(100, 300)]
    design._make = dict(design._make) | {"net": lambda: spark.createDataFrame(many, schema.TABLES["net"])}
    found = [r.what for r in verify.dangling(design).collect()]
    assert {w for w in found if int(w) >= 100} == {"100", "150", "200", "250"}


# --- scratch tables ----------------------------------------------------------------------------
def test_threads_leave_the_session_as_it_was(spark):
    from concurrent.futures import ThreadPoolExecutor

    from wirespan.functions import tables

    before = spark.conf.get(tables.CLEANUP)
    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(lambda k: tables.written(spark.range(k + 1)).count(), range(8))) == list(range(1, 9))
    assert spark.conf.get(tables.CLEANUP) == before
