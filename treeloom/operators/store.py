"""Keyed upserts, stale deletes and idempotent ingest over Parquet tables with atomic snapshots.

A store is a folder of tables. An ingest, of one build or of thousands, writes the whole state of its
builds to new folders (data/TABLE/commit=ID/domain=D/version=V), then a table of heads that names the
commit of each build, and at last one manifest, which is put in place by a rename. Readers take the
newest manifest and see what its heads name: all of an ingest or nothing of it. A manifest has the
number after its parent's; where another writer has that number by then, the rename fails and the ingest is a Conflict.
"""

from __future__ import annotations

import json
import uuid

from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

PARTITION = ["domain", "version"]


def on_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in keys])


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Source rows replace target rows with the same keys; columns missing in the source are null."""
    kept = target.join(source, on_keys(target, source, keys), "left_anti")
    return kept.unionByName(source, allowMissingColumns=True)


def upsert_set(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Like upsert, but fields that the source doesn't have keep their values."""
    s = source.select(*[F.col(c).alias(f"{c}__s") for c in source.columns], F.lit(True).alias("hit"))
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{k}__s")) for k in keys])
    both = target.join(s, cond, "full_outer")
    return both.select(*[F.when(F.col("hit"), F.col(f"{c}__s")).otherwise(F.col(c)).alias(c) if c in source.columns else F.col(c) for c in target.columns])


def stale_all(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Target rows that the source no longer has; an empty source makes all of them stale."""
    return target.join(source, on_keys(target, source, keys), "left_anti")


def stale_scoped(target: DataFrame, source: DataFrame, scope: list[str], keys: list[str]) -> DataFrame:
    """Stale rows only within scopes that the source still has: rows of a dropped scope are never stale."""
    scopes = source.select(*scope).distinct()
    return stale_all(target.join(scopes, on_keys(target, scopes, scope), "left_semi"), source, scope + keys)


def without(target: DataFrame, stale: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(stale, on_keys(target, stale, keys), "left_anti")


def unchanged(source: DataFrame, stored: DataFrame, keys: list[str], digest: str = "hash") -> DataFrame:
    """Source rows whose hash is the stored one: their ingest is skipped."""
    return source.join(stored, on_keys(source, stored, keys) & (source[digest] == stored[digest]), "left_semi")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Violations of a unique index."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


class Conflict(RuntimeError):
    """Another writer has committed since this one began; nothing of this one is visible."""


class Store:
    """Tables of builds: meta, docs, flows, attributes, validations, changelogs."""

    TABLES = ("docs", "flows", "attributes", "validations")
    HEADS = "domain string, version string, commit string, hash string"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # snapshots

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self):
        return self._path("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def snapshot(self) -> dict:
        """The newest manifest: number, parent, folder of the heads, schemas of the tables."""
        folder = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs().listStatus(folder)] if self._fs().exists(folder) else []
        numbers = [int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()]
        if not numbers:
            return {"number": 0, "heads": None, "schemas": {}}
        return json.loads(self.spark.read.text(f"{self.root}/manifests/{max(numbers):012d}.json", wholetext=True).first().value)

    def heads(self, snapshot: dict | None = None) -> DataFrame:
        """domain, version, commit, hash of every build that a snapshot holds."""
        at = (snapshot or self.snapshot())["heads"]
        return self.spark.read.schema(self.HEADS).parquet(f"{self.root}/{at}") if at else self.spark.createDataFrame([], self.HEADS)

    def _commit(self, before: dict, touched: DataFrame, schemas: dict) -> None:
        """Make `touched` heads of a new snapshot; `before` is the one that they were made from."""
        at = f"heads/{uuid.uuid4().hex}"
        upsert(self.heads(before), touched, PARTITION).write.parquet(f"{self.root}/{at}")
        number = before["number"] + 1
        manifest = {"number": number, "parent": before["number"], "heads": at, "schemas": before["schemas"] | schemas}
        new, place = self._path(f"manifests/.{uuid.uuid4().hex}"), self._path(f"manifests/{number:012d}.json")
        out = self._fs().create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        options = gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)  # none: an existing manifest is never replaced
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(new, place, options)
        except Py4JJavaError as e:
            self._fs().delete(new, False)
            if "FileAlreadyExists" in str(e.java_exception):
                raise Conflict(f"snapshot {number} is another writer's") from e
            raise

    def _write(self, name: str, rows: DataFrame, commit: str) -> str:
        """A table's rows of a commit; returns its schema."""
        rows.repartition(*PARTITION).write.partitionBy(*PARTITION).parquet(f"{self.root}/data/{name}/commit={commit}")
        return StructType([f for f in rows.schema if f.name not in PARTITION]).json()

    def vacuum(self) -> int:
        """Delete folders of commits that no head of the newest snapshot names; returns their number. For times without readers of older snapshots and without writers."""
        live, gone = {r.commit for r in self.heads().select("commit").distinct().collect()}, 0
        for name in (f.getPath().getName() for f in self._fs().listStatus(self._path("data"))):
            for folder in [f.getPath() for f in self._fs().listStatus(self._path(f"data/{name}"))]:
                if folder.getName().removeprefix("commit=") not in live:
                    self._fs().delete(folder, True)
                    gone += 1
        return gone

    # reading

    def exists(self, name: str) -> bool:
        return name in self.snapshot()["schemas"]

    def table(self, name: str, snapshot: dict | None = None) -> DataFrame | None:
        """All current rows of a table."""
        snapshot = snapshot or self.snapshot()
        if name not in snapshot["schemas"]:
            return None
        schema = StructType.fromJson(json.loads(snapshot["schemas"][name]))
        for c in ("commit", *PARTITION):
            schema = schema.add(c, "string")
        rows = self.spark.read.schema(schema).parquet(f"{self.root}/data/{name}")
        return rows.join(self.heads(snapshot).select("commit", *PARTITION), ["commit", *PARTITION], "left_semi").drop("commit")

    def read(self, name: str, domain: str, version: str, columns: list[str] | None = None) -> DataFrame | None:
        """Point read: the filter prunes partitions, the selection columns."""
        t = self.table(name)
        if t is None:
            return None
        t = t.where((F.col("domain") == domain) & (F.col("version") == version))
        return t.select(*columns) if columns else t

    # ingest

    def ingest_many(self, builds: DataFrame, sections: tuple | None = None, flows: DataFrame | None = None) -> DataFrame:
        """Ingest builds, rows (doc JSON) with an optional `ord`: domain, version, hash, status, changes of each.

        A build whose hash is stored is `skipped`; of several with one domain and version the last in order counts,
        the others are `replaced`, as are those without order but for the greatest text; one without domain or version is `rejected`.
        `flows` are rows (domain, version, ord, flow as JSON text) of builds that have more of them than fit in a document, which
        has none of them then; they are stored as they are, and the build's hash is of both.
        The number of jobs doesn't depend on the number of builds. Changes are the entries of the change log
        against the stored build; without changes the earlier log stays. Without a changed build there is no new snapshot.
        """
        from ..plans import builds as B
        from .cut import written

        before, commit, d = self.snapshot(), uuid.uuid4().hex, F.col("doc")
        order = F.struct(F.col("ord") if "ord" in builds.columns else F.lit(0).alias("ord"), "doc")
        digest, beside = F.sha2("doc", 256), None
        arrived = builds.select("doc", order.alias("ord"), digest.alias("hash"), B.part(d, "info", "domain").alias("domain"), B.part(d, "info", "version").alias("version"))
        arrived = written(arrived.withColumn("row", F.monotonically_increasing_id()), "arrived-builds")
        if flows is not None:
            flows = flows.select(*PARTITION, F.col("ord").cast("long").alias("ord"), "flow")
            told = lambda *more: F.xxhash64("ord", "flow", *[F.lit(x) for x in more])
            own = flows.groupBy(*PARTITION).agg(F.concat_ws(":", F.count(F.lit(1)), F.sum(told().cast("decimal(38,0)")), F.sum(told(1).cast("decimal(38,0)"))).alias("flows"))
            arrived = written(arrived.join(own, PARTITION, "left").withColumn("hash", F.when(F.col("flows").isNull(), F.col("hash")).otherwise(F.sha2(F.concat_ws(":", "hash", "flows"), 256))).drop("flows"), "arrived-hashes")
        named = arrived.where("domain is not null and version is not null")
        last = named.groupBy(*PARTITION).agg(F.max_by(F.struct("row", "hash", "doc"), F.struct("ord", "row")).alias("b")).select(*PARTITION, "b.*")
        known = self.heads(before).select(*PARTITION, "hash")
        fresh = last.join(known, [*PARTITION, "hash"], "left_anti")
        schemas = {"meta": self._write("meta", fresh.select("hash", "doc", "row", F.current_timestamp().alias("updated_at"), *PARTITION), commit)}
        meta = self.spark.read.schema("hash string, doc string, row bigint, domain string, version string").parquet(f"{self.root}/data/meta/commit={commit}")
        new = meta.select(F.to_json(F.struct(*PARTITION)).alias("build"), "doc")
        label = lambda df: df.withColumn("b", F.from_json("build", "domain string, version string")).withColumns({k: F.col(f"b.{k}") for k in PARTITION}).drop("build", "b")
        touched, logs = meta.select(*PARTITION), None
        changed = not touched.isEmpty()
        texts = lambda t: t.select(F.to_json(F.struct(*PARTITION)).alias("build"), "ord", "flow")
        if changed and flows is not None:
            schemas["flow_texts"] = self._write("flow_texts", flows.join(touched, PARTITION, "left_semi"), commit)
            beside = texts(self.spark.read.schema("ord bigint, flow string, domain string, version string").parquet(f"{self.root}/data/flow_texts/commit={commit}"))
        if changed and (was := self.table("meta", before)) is not None:
            old = was.join(touched, PARTITION, "left_semi").select(F.to_json(F.struct(*PARTITION)).alias("build"), "doc")
            stored = self.table("flow_texts", before)
            stored = None if stored is None else texts(stored.join(touched, PARTITION, "left_semi"))
            log = label(B.section_table(B.changelog(old, new, sections or B.STORE_SECTIONS, (stored, beside)))).withColumns({"from_version": F.col("version"), "to_version": F.col("version")})
            schemas["changelogs"] = self._write("new_changelogs", log, commit)
            logs = self.spark.read.schema(StructType.fromJson(json.loads(schemas["changelogs"])).add("domain", "string").add("version", "string")).parquet(f"{self.root}/data/new_changelogs/commit={commit}")
            kept = self.table("changelogs", before)
            if kept is not None:
                kept = kept.join(touched, PARTITION, "left_semi").join(logs.select(*PARTITION).distinct(), PARTITION, "left_anti")
            self._write("changelogs", logs if kept is None else logs.unionByName(kept), commit)
        if changed:
            rows = {"docs": B.docs(new), "flows": B.flows(new, beside), "attributes": B.attribute_sets(new), "validations": B.validations(new)}
            for name in self.TABLES:
                own = label(rows[name])
                schemas[name] = self._write(name, self._flows(own, touched, before) if name == "flows" else own, commit)
            self._commit(before, meta.select(*PARTITION, F.lit(commit).alias("commit"), "hash"), schemas)
        changes = logs.groupBy(*PARTITION).agg(F.count("*").alias("changes")) if logs is not None else touched.withColumn("changes", F.lit(0).cast("long")).limit(0)
        done = meta.select("row", F.lit("ingested").alias("done"))
        status = F.coalesce("done", F.when(F.col("domain").isNull() | F.col("version").isNull(), "rejected").when(F.col("chosen").isNull(), "replaced").otherwise("skipped"))
        told = arrived.join(done, "row", "left").join(last.select("row", F.lit(True).alias("chosen")), "row", "left").join(changes, PARTITION, "left")
        return told.select(*PARTITION, "hash", status.alias("status"), F.when(status == "ingested", F.coalesce("changes", F.lit(0))).otherwise(0).cast("long").alias("changes"))

    def _flows(self, rows: DataFrame, touched: DataFrame, before: dict) -> DataFrame:
        """The flows that builds have after an ingest: of one use case and id the last one, and stored flows whose use case the build no longer has."""
        keys = [*PARTITION, "usecase", "id"]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), "ord").alias("r")).select(*keys, "r.*")
        stored = self.table("flows", before)
        if stored is None:
            return rows
        cases = rows.select(*PARTITION, "usecase").distinct()
        stored = stored.join(touched, PARTITION, "left_semi")
        return stored.join(cases, on_keys(stored, cases, [*PARTITION, "usecase"]), "left_anti").unionByName(rows)

    def ingest(self, build: DataFrame, sections: tuple | None = None) -> dict:
        """Ingest one build, a row (doc JSON). Returns skipped, hash, changes and the number of its rows in each table."""
        told = self.ingest_many(build.select("doc"), sections).first()
        if told.status != "ingested":
            return {"skipped": told.status == "skipped", "hash": told.hash, "changes": 0}
        return {"skipped": False, "hash": told.hash, "changes": told.changes, **{name: self.read(name, told.domain, told.version).count() for name in self.TABLES}}

    def ingest_validation_table(self, rows: DataFrame) -> int:
        """rows: domain, version, action, rows JSON. Always replaces, in a table of its own beside the snapshots; returns the number of action keys."""
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITION).parquet(f"{self.root}/validation_table")
        return rows.select("action").distinct().count()
