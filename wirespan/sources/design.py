"""A design: its tables as DataFrames, read from Parquet or made of the star tables, and saved again."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from wirespan.functions.tables import written
from wirespan.sources import integrity, publish, schema, star

#: Columns that rows of a table are looked up by; saved tables are sorted by them, so that scans can skip row groups.
SORT_KEYS = {"net_dep": "tgt_net_id", "net_conn": "outer_net_id", "term_map": "inner_net_id", "tree_node": "parent_node_id", "stmt_target": "net_id", "assign_operand": "net_id", "expr_ref": "net_id", "proc_event": "net_id", "hier_ref": "resolved_net_id", "inst_param": "name"}
#: Other columns that rows are looked up by: bloom filters tell scans which row groups cannot have a value.
SEEK_KEYS = {
    "tree_node": ("id", "name"), "inst": ("id", "module_id", "parent_inst_id"), "inst_param": ("inst_id",), "prim": ("id", "inst_id"), "net": ("id", "inst_id", "scope_node_id", "name"), "term": ("id", "inst_id"), "term_map": ("term_id",),
    "net_conn": ("id", "term_id", "outer_intf_inst_id", "outer_hier_ref_id"), "proc": ("id", "inst_id"), "stmt": ("id", "inst_id", "proc_id", "call_site_id"), "stmt_target": ("id", "stmt_id"), "assign_operand": ("id", "stmt_id"), "expr_ref": ("id", "stmt_id"),
    "proc_event": ("proc_id", "stmt_id"), "net_dep": ("src_net_id", "stmt_id", "assign_operand_id", "stmt_target_id", "expr_ref_id", "prim_id", "src_hier_ref_id", "tgt_hier_ref_id", "call_site_id"), "hier_ref": ("id", "inst_id", "stmt_id"), "call_site": ("id", "inst_id", "caller_stmt_id", "parent_call_site_id"),
}


_KEPT: dict[tuple, dict[str, DataFrame]] = {}


def _state(spark: SparkSession, sf_dir: str) -> tuple:
    """The files of the star tables, with sizes and times: another state is another design."""
    out = []
    for name in star.BASE:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        for f in files.listStatus(path):
            out.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(out))


class VersionError(ValueError):
    pass


class IntegrityError(ValueError):
    pass


class Design(Mapping):
    """name -> DataFrame for the 22 tables; each is made when first asked for."""

    def __init__(self, spark: SparkSession, make: Mapping):
        self.spark, self._make, self._made = spark, make, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._make[name]()
        return self._made[name]

    def __iter__(self):
        return iter(schema.TABLES)

    def __len__(self):
        return len(schema.TABLES)

    @classmethod
    def load(cls, spark: SparkSession, path: str, check: bool = False) -> Design:
        """From the newest version published in a folder, or else the folder's own Parquet tables, one each; refuses a schema version it does not know. check: also
        what the manifest does not agree with."""
        path = publish.current(spark, path) or path
        design = cls(spark, {t: (lambda t=t: spark.read.schema(schema.TABLES[t]).parquet(f"{path}/{t}")) for t in schema.TABLES})
        found = design["meta"].where("key = 'schema_version'").agg(F.max("value")).first()[0]
        if found != str(schema.VERSION):
            raise VersionError(f"schema version {found}, not {schema.VERSION}")
        if check:
            wrong = integrity.problems(integrity.read_manifest(spark, path), design).collect()
            if wrong:
                raise IntegrityError("; ".join(f"{r.table_name}: {r.problem}, {r.found} for {r.recorded}" for r in sorted(wrong)))
        return design

    @classmethod
    def of(cls, spark: SparkSession, tables: Mapping[str, DataFrame | list]) -> Design:
        """From DataFrames or lists of rows; tables left out are empty. Lists become local relations, so that Catalyst
        knows their sizes and drops what joins an empty one."""

        def make(name):
            given, columns = tables.get(name, []), schema.TABLES[name]
            if isinstance(given, DataFrame):
                return given
            table = pa.Table.from_pylist([dict(zip(columns.names, r, strict=True)) for r in given], schema=to_arrow_schema(columns))
            return spark.createDataFrame(table, columns)

        return cls(spark, {t: (lambda t=t: make(t)) for t in schema.TABLES})

    @classmethod
    def of_star(cls, spark: SparkSession, sf_dir: str, keep: bool = False) -> Design:
        """Of the star tables in a folder (see wirespan.sources.star). keep: each table is written to the shared
        folder when first asked for, and read from there by all later designs of the same files in this application."""
        made = _KEPT.setdefault((spark.sparkContext.applicationId, _state(spark, sf_dir)), {}) if keep else {}

        def frame(name: str) -> DataFrame:
            if name not in made:
                if name in star.SQL:
                    sql = re.sub(r"SHA\(((?:[^()]|\([^()]*\))*)\)", r"sha2(\1, 256)", star.SQL[name])
                    made[name] = spark.sql(sql, **{x: frame(x) for x in set(re.findall(r"\{(\w+)\}", sql))})
                    if keep and name in schema.TABLES:
                        made[name] = written(made[name].sortWithinPartitions(SORT_KEYS[name]) if name in SORT_KEYS else made[name])
                else:
                    made[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return made[name]

        return cls(spark, {t: (lambda t=t: frame(t)) for t in schema.TABLES})

    def register(self, prefix: str = "") -> None:
        """Temporary views of all tables and of the design's views."""
        for name in schema.TABLES:
            self[name].createOrReplaceTempView(prefix + name)
        for name, view in self.views.items():
            view().createOrReplaceTempView(prefix + name)

    @cached_property
    def views(self) -> dict:
        from wirespan.operators import views

        return {name: (lambda f=f: f(self)) for name, f in views.VIEWS.items()}

    def save(self, path: str, manifest: bool = True, row_group_bytes: int | None = None) -> int:
        """Publishes the tables as a new version in a folder (see wirespan.sources.publish) and returns its number: a sorted Parquet table each, with bloom filters on the
        columns that are looked up but not sorted by, and the manifest of what was written. Readers see the old version until all of it is there."""
        version = publish.new_version(path)
        for name in schema.TABLES:
            df = self[name].select(*(F.col(f.name).cast(f.dataType) for f in schema.TABLES[name]))
            if name in SORT_KEYS:
                df = df.repartitionByRange(SORT_KEYS[name]).sortWithinPartitions(SORT_KEYS[name])
            options = {f"parquet.bloom.filter.enabled#{c}": "true" for c in SEEK_KEYS.get(name, ())}
            if row_group_bytes:
                options["parquet.block.size"] = str(row_group_bytes)
            df.write.options(**options).parquet(f"{version}/{name}")
        stored = {t: self.spark.read.schema(schema.TABLES[t]).parquet(f"{version}/{t}") for t in schema.TABLES}
        rows = integrity.digests(stored) if manifest else self.spark.createDataFrame([], integrity.MANIFEST)
        rows.coalesce(1).write.json(f"{version}/manifest")
        return publish.publish(self.spark, path, version)
