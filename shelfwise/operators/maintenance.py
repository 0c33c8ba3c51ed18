"""Table writes as batch jobs: SNK-2 (keyed update), SNK-3 (upsert), SNK-4
(delete with the declared cascade), SNK-5 (re-key), WN-5 (surrogate keys),
WN-6 (latest change per key).

Every function returns the new table as a DataFrame; callers write it to a
*new* path (``write_version``) and then read from there, never overwriting a
path that the plan is still reading.
"""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.expressions import as_of_literal
from shelfwise.operators.scan import running_sum
from shelfwise.schemas import FOREIGN_KEYS


def latest_changes(changes: DataFrame, key: str | list[str], ts: str = "ts",
                   tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """WN-6: the last change per key (last write wins) by ``ts`` then
    ``tiebreak``.  ``max_by`` over a struct is mergeable, so a key with a
    huge number of changes is reduced map-side."""
    keys = [key] if isinstance(key, str) else list(key)
    rest = [c for c in changes.columns if c not in keys]
    order = F.struct(F.col(ts), *[F.col(c) for c in tiebreak])
    return (changes.groupBy(*keys)
            .agg(F.max_by(F.struct(*[F.col(c) for c in rest]), order).alias("_last"))
            .select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest]))


def apply_updates(target: DataFrame, changes: DataFrame, key: str, cols: list[str],
                  as_of=None, updated_at: str | None = "updated_at") -> DataFrame:
    """SNK-2: set ``cols`` on rows whose ``key`` has a change; other rows and
    columns are untouched.  Of several changes to one key the last counts: by
    ``ts`` when ``changes`` has that column, then by the new values (one change
    per key is what :func:`latest_changes` gives).  A match flag (not ``coalesce``) decides, so an
    update *to* NULL is kept.  ``updated_at`` is refreshed on changed rows
    (``as_of``, or the change's own ``ts`` column when ``as_of='ts'``)."""
    order = F.struct(*[F.col(c) for c in (["ts"] if "ts" in changes.columns else []) + list(cols)])
    kept = list(dict.fromkeys([*cols, *(["ts"] if as_of == "ts" else [])]))
    changes = (changes.groupBy(key).agg(F.max_by(F.struct(*kept), order).alias("_c"))
               .select(key, *[F.col(f"_c.{c}").alias(c) for c in kept]))
    ch = changes.select(F.col(key).alias("_key"), F.lit(True).alias("_hit"),
                        *[F.col(c).alias(f"_new_{c}") for c in cols],
                        *([F.col("ts").alias("_new_ts")] if as_of == "ts" else []))
    j = target.join(ch, target[key] == ch["_key"], "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    out = []
    for c in target.columns:
        if c in cols:
            out.append(F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c))
                       .cast(target.schema[c].dataType).alias(c))
        elif updated_at and c == updated_at:
            stamp = F.col("_new_ts") if as_of == "ts" else as_of_literal(as_of)
            out.append(F.when(hit, stamp).otherwise(F.col(c)).cast(target.schema[c].dataType).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def assign_ids(target: DataFrame, rows: DataFrame, order_by: list[str],
               id_col: str = "id") -> DataFrame:
    """WN-5: give new rows consecutive keys after the current largest key, in
    ``order_by`` order (AUTO_INCREMENT for a batch).

    The position of each row is the global running count of
    :func:`~shelfwise.operators.scan.running_sum`.  The current maximum is a
    one-row aggregate joined on a constant.
    """
    one = "_one"
    numbered = running_sum(rows.withColumn(one, F.lit(1)), [], order_by, [one], ["_pos"])
    top = target.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("long").alias("_top")) \
        .withColumn("_c", F.lit(1))
    out = (numbered.withColumn("_c", F.lit(1)).join(F.broadcast(top), "_c")
           .withColumn(id_col, (F.col("_top") + F.col("_pos")).cast("long"))
           .drop("_c", "_top", "_pos", one))
    return out.select(id_col, *[c for c in rows.columns if c != id_col])


def upsert(target: DataFrame, rows: DataFrame, key: str, update_cols: list[str],
           id_col: str | None = "id", order_by: list[str] | None = None, fold_case: bool = False,
           defaults: str | None = None, as_of=None) -> DataFrame:
    """SNK-3: update ``update_cols`` where ``key`` exists, insert otherwise.

    ``rows`` is first reduced to one row per key: the last by ``ts`` when it has
    that column, then by its values.  With ``fold_case`` keys are compared in
    lower case, as the database's collation does; a row that is updated keeps the
    key as it stands.  ``defaults`` names the shop table whose declared defaults
    inserted rows take where ``rows`` is silent, and ``as_of`` stamps
    ``updated_at`` (and ``created_at`` of inserts) if the target has them.
    Inserted rows get new ids after the current largest (WN-5) when ``id_col`` is
    given.  Running it twice equals running it once.
    """
    from shelfwise.sources.tables import with_defaults

    fold = (lambda c: F.lower(c)) if fold_case else (lambda c: c)
    named = [c for c in rows.columns if c != "ts"]
    order = F.struct(*[F.col(c) for c in (["ts"] if "ts" in rows.columns else []) + named])
    one = (rows.filter(F.col(key).isNotNull()).groupBy(fold(F.col(key)).alias("_k"))
           .agg(F.max_by(F.struct(*named), order).alias("_r")).select("_k", "_r.*"))
    taken = target.select(fold(F.col(key)).alias("_k"), F.lit(True).alias("_hit")).distinct()
    inserts = one.join(taken, "_k", "left_anti").drop("_k")
    stamp = as_of is not None and "updated_at" in target.columns
    updated = apply_updates(target.withColumn("_k", fold(F.col(key))), one.select("_k", *update_cols), "_k", update_cols,
                            as_of=as_of, updated_at="updated_at" if stamp else None).drop("_k")
    if id_col is not None and id_col not in rows.columns:
        inserts = assign_ids(target, inserts, order_by or [key], id_col)
    if stamp:
        for c in ("created_at", "updated_at"):
            if c in target.columns and c not in rows.columns:
                inserts = inserts.withColumn(c, as_of_literal(as_of).cast(target.schema[c].dataType))
    if defaults is not None:
        inserts = with_defaults(inserts, defaults)
        inserts = inserts.select(*[c for c in inserts.columns if c in target.columns])
    return updated.unionByName(inserts, allowMissingColumns=True).select(*target.columns)


def rekey(parent_changes: DataFrame, child: DataFrame, fk: str) -> DataFrame:
    """SNK-5: ON UPDATE CASCADE: rewrite ``fk`` from ``old_id`` to ``new_id``."""
    ch = parent_changes.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))
    j = child.join(ch, child[fk] == ch["_old"], "left")
    return j.select(*[F.coalesce(F.col("_new"), F.col(c)).cast(child.schema[c].dataType).alias(c)
                      if c == fk else F.col(c) for c in child.columns])


class RestrictViolation(RuntimeError):
    pass


def delete_cascade(tables: dict[str, DataFrame], root: str, keys: DataFrame,
                   pk: str = "id", foreign_keys=FOREIGN_KEYS) -> dict[str, DataFrame]:
    """SNK-4: delete ``keys`` from ``root`` and apply each declared foreign
    key's ON DELETE rule to the tables given: CASCADE deletes referencing
    rows (recursively), SET NULL clears the reference, RESTRICT raises
    :class:`RestrictViolation` if a referencing row exists.

    Deletions are anti joins in topological order; a table referenced by
    several parents loses rows deleted through any of them.
    """
    children = defaultdict(list)
    for child, fk, parent, ppk, rule in foreign_keys:
        if child in tables and parent in tables:
            children[parent].append((child, fk, ppk, rule))

    deleted: dict[str, DataFrame] = {root: keys.select(F.col(pk).alias(pk)).distinct()}
    out = dict(tables)
    out[root] = tables[root].join(deleted[root], pk, "left_anti")
    queue = [root]
    while queue:
        parent = queue.pop(0)
        for child, fk, ppk, rule in children[parent]:
            gone = deleted[parent].select(F.col(pk).alias(fk))
            hit = out[child].join(gone, fk, "left_semi")
            if rule == "RESTRICT":
                if not hit.limit(1).isEmpty():
                    raise RestrictViolation(f"{child}.{fk} still references deleted {parent} rows")
                continue
            if rule == "SET NULL":
                flag = gone.withColumn("_gone", F.lit(True))
                out[child] = (out[child].join(flag, fk, "left")
                              .withColumn(fk, F.when(F.col("_gone"), F.lit(None))
                                          .otherwise(F.col(fk)).cast(tables[child].schema[fk].dataType))
                              .drop("_gone").select(*tables[child].columns))
                continue
            out[child] = out[child].join(gone, fk, "left_anti")
            if pk in tables[child].columns:
                more = hit.select(pk)
                deleted[child] = (deleted[child].unionByName(more).distinct()
                                  if child in deleted else more)
                queue.append(child)
    return out


def write_version(df: DataFrame, base: str, table: str, version: str) -> str:
    """Write a new version of a table under ``base/table/v=<version>`` and
    return its path (the caller points readers at it afterwards)."""
    path = f"{base.rstrip('/')}/{table}/v={version}"
    df.write.mode("errorifexists").parquet(path)
    return path
