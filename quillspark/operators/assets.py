"""Versioned assets: versions, lifecycle, permissions, audit, objects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scalars import retention_dates
from quillspark.operators.vector import latest_by_key

#: Permissions a shared user may hold (fixed values).
PERMISSIONS = ("upload", "download", "list", "archive", "destroy")


def head_versions(assets: DataFrame, key: list[str], upload: str = "upload_date", version: str = "version_id") -> DataFrame:
    """The newest version of each key; of equal upload times the larger version."""
    return latest_by_key(assets, key, F.desc(upload), F.desc(version))


def latest_active(assets: DataFrame, key: list[str], status: str = "status", active: str = "active", **names) -> DataFrame:
    return head_versions(assets.where(F.col(status) == active), key, **names)


def version_list(assets: DataFrame, key: str, value, status: str = "status", active: str = "active", upload: str = "upload_date") -> DataFrame:
    return assets.where((F.col(key) == value) & (F.col(status) == active)).orderBy(F.desc(upload))


def point_lookup(assets: DataFrame, asset_path: str, version_id: str, branch: str) -> DataFrame:
    return assets.where((F.col("asset_path") == asset_path) & (F.col("version_id") == version_id) & (F.col("branch") == branch))


def upsert(assets: DataFrame, batch: DataFrame, keys: list[str], keep: tuple[str, ...] = ("asset_key",)) -> DataFrame:
    """Insert or update by key; the columns in ``keep`` stay as first written."""
    a, b = assets.alias("o"), batch.alias("n")
    joined = a.join(b, keys, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in keep else F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}"))
    return joined.select(*keys, *[pick(c).alias(c) for c in assets.columns if c not in keys])


def with_retention(assets: DataFrame, archive_days: int | None = None, destroy_days: int | None = None, upload: str = "upload_date") -> DataFrame:
    return assets.withColumn("_r", retention_dates(F.col(upload), archive_days, destroy_days)).select(*assets.columns, "_r.archive_date", "_r.destroy_date")


def archive_due(assets: DataFrame, as_of: Column, status: str = "status") -> DataFrame:
    """Active assets whose archive date has come become archived."""
    due = (F.col(status) == "active") & (F.col("archive_date") <= as_of)
    return assets.withColumn(status, F.when(due, F.lit("archived")).otherwise(F.col(status)))


def destroy_due(assets: DataFrame, as_of: Column, key: list[str]) -> tuple[DataFrame, DataFrame]:
    """(assets that remain, destroyed ones with drop_object): archived assets whose destroy date has come go; the object
    itself goes only with the head version."""
    due = (F.col("status") == "archived") & (F.col("destroy_date") <= as_of)
    head = head_versions(assets, key).select(*key, F.col("version_id").alias("_head"))
    gone = assets.where(due).join(head, key).withColumn("drop_object", F.col("version_id") == F.col("_head")).drop("_head")
    return assets.where(~F.coalesce(due, F.lit(False))), gone


def permitted(users: DataFrame, assets: DataFrame, permission: str) -> DataFrame:
    """(user, asset) pairs that may act: the same branch, and admin or the permission.

    A user brings as many pairs as the branch has assets, so users are dealt over all tasks first, however few files hold them."""
    ok = F.array_contains("permissions", "admin") | F.array_contains("permissions", permission)
    tasks = int(users.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return users.where(ok).repartition(tasks, *[F.col(f"`{c}`") for c in users.columns]).join(assets, "branch")


def create_users(users: DataFrame, new: DataFrame, order: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(users after, rejected with error): an unknown permission or a name that a user, or an earlier accepted row of the batch, has is
    refused.  ``order``: columns that say which row of a batch comes first; by default all."""
    known = users.select("username", F.lit(True).alias("_known")).distinct()
    unknown = F.size(F.array_except("permissions", F.array(*[F.lit(p) for p in PERMISSIONS]))) > 0
    checked = new.join(known, "username", "left").withColumn("_bad", F.coalesce("_known", F.lit(False)) | unknown)
    turn = F.row_number().over(Window.partitionBy("username", "_bad").orderBy(*(order or new.columns)))
    error = F.when(F.col("_known"), "duplicate user").when(unknown, "unknown permission").when(F.col("_turn") > 1, "duplicate user")
    checked = checked.withColumn("_turn", turn).withColumn("error", error).drop("_known", "_bad", "_turn")
    return users.unionByName(checked.where("error is null").select(*users.columns)), checked.where("error is not null")


def change_permissions(users: DataFrame, changes: DataFrame) -> DataFrame:
    """New permission lists by name; admin can't be given to shared users."""
    ok = changes.where(~F.array_contains("permissions", "admin")).select("username", F.col("permissions").alias("_new"))
    return users.join(ok, "username", "left").withColumn("permissions", F.coalesce("_new", "permissions")).drop("_new")


def delete_users(users: DataFrame, names: DataFrame) -> DataFrame:
    return users.join(names.select("username"), "username", "left_anti")


def associated(assets: DataFrame, objects: DataFrame) -> DataFrame:
    """One row per associated file (name, version) of an asset, with its object if there is one."""
    rows = assets.select("asset_path", F.explode("associated_filenames").alias("f")).select("asset_path", F.col("f.name").alias("name"), F.col("f.version").alias("version"))
    return rows.join(objects, ["name", "version"], "left")


def merge_associated(old: Column, new: Column) -> Column:
    """Map of associated files: a new entry replaces an old one of the same name."""
    return F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)


def commit(commits: DataFrame, uploads: DataFrame) -> DataFrame:
    """Append-only commits (path, branch, version, ts): the version is the content's SHA-256; content equal to what stands at the path
    before it, the head or an earlier upload of the batch, makes no commit.  An upload without content deletes the path: a commit
    without version, which deleting again doesn't repeat."""
    head = latest_by_key(commits, ["path", "branch"], F.desc("ts"), F.desc_nulls_first("version")).select("path", "branch", F.col("version").alias("_head"))
    new = uploads.withColumn("version", F.sha2("content", 256)).join(head, ["path", "branch"], "left")
    w = Window.partitionBy("path", "branch").orderBy("ts", F.asc_nulls_last("version"))
    before = F.when(F.row_number().over(w) == 1, F.col("_head")).otherwise(F.lag("version").over(w))
    new = new.withColumn("_before", before).where(~F.col("version").eqNullSafe(F.col("_before")))
    return commits.unionByName(new.select("path", "branch", "version", "ts"))


def standing(commits: DataFrame) -> DataFrame:
    """(path, branch, version, ts): what stands at each path; deleted ones don't."""
    return latest_by_key(commits, ["path", "branch"], F.desc("ts"), F.desc_nulls_first("version")).where("version is not null").select("path", "branch", "version", "ts")


def branches(commits: DataFrame, prefix: str | None = None) -> DataFrame:
    """(path, branches): per repository its branches with their latest commit."""
    rows = commits if prefix is None else commits.where(F.startswith("path", F.lit(prefix)))
    last = rows.groupBy("path", "branch").agg(F.max(F.struct("ts", "version")).alias("c"))
    return last.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("branch", "c.version", "c.ts"))).alias("branches"))


def drop_associated(objects: DataFrame, prefix: str, primary: str) -> DataFrame:
    """Objects left after all below the prefix that don't carry the primary name are deleted."""
    return objects.where(~(F.startswith("path", F.lit(prefix)) & ~F.contains("path", F.lit(primary))))


def presigned_path(host: str, repository: Column, ref: Column, path: Column) -> Column:
    return F.concat(F.lit(host.rstrip("/") + "/"), repository, F.lit("/"), ref, F.lit("/"), F.url_encode(path))


def audit(log: DataFrame, entries: DataFrame) -> DataFrame:
    """The append-only log; destroying an asset leaves its entries."""
    return log.unionByName(entries, allowMissingColumns=True)


def purge_audit(log: DataFrame, before: Column) -> DataFrame:
    return log.where(F.col("ts") >= before)


def audit_stats(log: DataFrame) -> DataFrame:
    return log.groupBy("operation", "success").agg(F.count(F.lit(1)).alias("n"))


def missing_artifacts(remote: DataFrame, manifest: DataFrame) -> DataFrame:
    """Objects of a commit that are not there yet: downloading twice copies nothing twice."""
    return remote.join(manifest.select("path", "commit_id"), ["path", "commit_id"], "left_anti")


def set_status(assets: DataFrame, asset_path, version_id, status: str, branch: str | None = None) -> DataFrame:
    """The status of one version changed, on one branch or on all."""
    hit = (F.col("asset_path") == asset_path) & (F.col("version_id") == version_id)
    if branch is not None:
        hit &= F.col("branch") == branch
    return assets.withColumn("status", F.when(hit, F.lit(status)).otherwise(F.col("status")))


def delete_versions(assets: DataFrame, kill: DataFrame, on: tuple[str, ...] = ("asset_path", "version_id")) -> DataFrame:
    return assets.join(kill.select(*on).distinct(), list(on), "left_anti")


def read_version(commits: DataFrame, objects: DataFrame, version: str | None = None) -> DataFrame:
    """Objects (path, branch, version, content) at a version, or at each branch's head."""
    if version is not None:
        return objects.where(F.col("version") == version)
    head = commits.groupBy("path", "branch").agg(F.max(F.struct("ts", "version")).alias("c")).select("path", "branch", F.col("c.version").alias("version"))
    return objects.join(head, ["path", "branch", "version"])


def create_tables(spark, database: str = "default") -> None:
    """The tables of the store, where they don't exist yet."""
    for name, schema in {
        "assets": "asset_path string, version_id string, branch string, primary_filename string, asset_key string, upload_date timestamp, archive_date timestamp, destroy_date timestamp, status string",
        "users": "username string, branch string, permissions array<string>",
        "audit_log": "username string, asset_path string, version_id string, branch string, operation string, ts timestamp, success boolean, details string",
        "commits": "path string, branch string, version string, ts timestamp",
    }.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({schema}) USING parquet")
