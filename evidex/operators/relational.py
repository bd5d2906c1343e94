"""Nested records, pages, scopes, queues and integrity over relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType


def ordered_list(order: list[str], value: Column) -> Column:
    """An aggregate: the values as an array, by a total order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_value")))), lambda x: x["_value"])


def nest(parents: DataFrame, children: DataFrame, on: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """parents with an array of their children's values, by order, empty where there are none."""
    grouped = children.groupBy(*on).agg(ordered_list(order, value).alias(name))
    return parents.join(grouped, on, "left").withColumn(name, F.coalesce(name, F.array().cast(grouped.schema[name].dataType)))


def conditional(present: Column, *fields: Column) -> Column:
    """A sub-document, or null where it isn't present."""
    return F.when(present, F.struct(*fields))


def row_json(*columns: str) -> Column:
    """The row as JSON that keeps its nulls."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def object_of(key: Column, value: Column) -> Column:
    """An aggregate: a map of keys to values; keys are unique in a group."""
    return F.map_from_entries(F.collect_list(F.struct(key.alias("k"), value.alias("v"))))


def owner_scope(rows: DataFrame, caller: Column | str, owner: str = "owner") -> DataFrame:
    """Only the caller's rows; the predicate reaches the scan."""
    return rows.where(F.col(owner) == caller)


def encode_cursor(ts: Column, key: Column) -> Column:
    stamp = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.translate(F.base64(F.encode(F.concat(stamp, F.lit("|"), key.cast("string")), "UTF-8")), "+/", "-_")


def decode_cursor(cursor: Column, kind: DataType) -> tuple[Column, Column]:
    text = F.split(F.decode(F.unbase64(F.translate(cursor, "-_", "+/")), "UTF-8"), r"\|")
    return F.get(text, F.lit(0)).cast(kind), F.get(text, F.lit(1))


def keyset_page(rows: DataFrame, *, ts: str, key: str, limit: int, cursor: Column | None = None) -> DataFrame:
    """The next ``limit`` rows by ts and key, newest first, after the cursor; next_cursor is that of the last row if more follow, else null.

    One row more than a page is fetched, by TakeOrderedAndProject, so nothing is sorted whole.
    """
    if cursor is not None:
        at, last = decode_cursor(cursor, rows.schema[ts].dataType)
        last = last.cast(rows.schema[key].dataType)
        rows = rows.where((F.col(ts) < at) | ((F.col(ts) == at) & (F.col(key) < last)))
    page = rows.orderBy(F.desc(ts), F.desc(key)).limit(limit + 1)
    place = F.row_number().over(Window.orderBy(F.desc(ts), F.desc(key)))
    numbered = page.withColumn("_n", place).withColumn("_more", F.max("_n").over(Window.partitionBy()) > limit)
    following = F.when((F.col("_n") == limit) & F.col("_more"), encode_cursor(F.col(ts), F.col(key)))
    return numbered.withColumn("next_cursor", following).where(F.col("_n") <= limit).drop("_n", "_more")


def eligible(as_of: Column, *, max_attempts: int = 3) -> Column:
    """(queued and due) or (running with an expired lease), with attempts left."""
    due = (F.col("status") == "queued") & (F.col("next_attempt_at") <= as_of)
    expired = (F.col("status") == "running") & (F.col("lease_until") <= as_of)
    return (due | expired) & (F.col("attempt") < max_attempts)


def claim(jobs: DataFrame, *, as_of: Column, lease_seconds: int = 120, max_attempts: int = 3, concurrency: int | None = 1) -> DataFrame:
    """The job a worker gets next, with its new token, attempt and lease; none while ``concurrency`` leases are live (None: however many are)."""
    best = jobs.where(eligible(as_of, max_attempts=max_attempts)).orderBy("next_attempt_at", "created_at", "id").limit(1)
    if concurrency is not None:
        live = jobs.agg(F.count_if((F.col("status") == "running") & (F.col("lease_until") > as_of)).alias("_live"))
        best = best.join(live, F.col("_live") < concurrency)
    return best.select(
        "id", (F.col("fencing_token") + 1).alias("fencing_token"), (F.col("attempt") + 1).alias("attempt"), (as_of + F.make_dt_interval(secs=F.lit(lease_seconds))).alias("lease_until")
    )


def exhausted(as_of: Column, *, max_attempts: int = 3) -> Column:
    """A running job whose lease has ended and that has no attempt left."""
    return (F.col("status") == "running") & (F.col("lease_until") < as_of) & (F.col("attempt") >= max_attempts)


def claim_effects(jobs: DataFrame, usage: DataFrame, attempts: DataFrame, *, as_of: Column, worker: str, lease_seconds: int = 120, max_attempts: int = 3, concurrency: int | None = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(jobs, usage, attempts) after a worker asked for a job.

    Exhausted jobs fail for good, whether or not a job is claimed. The claimed one gets the worker, a new token, attempt and lease; if another worker's lease on it has ended, that one's open reservations
    become uncertain. Its open attempts end as lease_expired, and an attempt under the new token begins. jobs: id, status, worker, attempt, fencing_token, lease_until, next_attempt_at, created_at, error_code;
    usage: job, state; attempts: job, fencing_token, worker, ended_at, outcome. Other columns stay.
    """
    dead = exhausted(as_of, max_attempts=max_attempts)
    best = claim(jobs.where(~F.coalesce(dead, F.lit(False))), as_of=as_of, lease_seconds=lease_seconds, max_attempts=max_attempts, concurrency=concurrency)
    mine = F.broadcast(best.select(F.col("id").alias("_id"), F.col("fencing_token").alias("_token"), F.col("attempt").alias("_attempt"), F.col("lease_until").alias("_lease")))  # one row at most
    got = F.col("_id").isNotNull()
    both = jobs.join(mine, F.col("id") == F.col("_id"), "left").withColumn("_dead", F.coalesce(dead, F.lit(False)))
    taken_over = both.where(got & (F.col("status") == "running")).select(F.col("id").alias("_over"))
    new = {
        "status": F.when(F.col("_dead"), "failed").when(got, "running").otherwise(F.col("status")), "worker": F.when(got, worker).when(~F.col("_dead"), F.col("worker")), "attempt": F.when(got, F.col("_attempt")).otherwise(F.col("attempt")),
        "fencing_token": F.when(got, F.col("_token")).otherwise(F.col("fencing_token")), "lease_until": F.when(got, F.col("_lease")).when(~F.col("_dead"), F.col("lease_until")), "error_code": F.when(F.col("_dead"), "provider_down").otherwise(F.col("error_code")),
    }
    after = both.withColumns({f"_{k}_": v for k, v in new.items()}).select(*[F.col(f"_{c}_" if c in new else c).alias(c) for c in jobs.columns])
    spent = usage.join(F.broadcast(taken_over), F.col("job") == F.col("_over"), "left")
    spent = spent.withColumn("state", F.when(F.col("_over").isNotNull() & (F.col("state") == "reserved"), "uncertain").otherwise(F.col("state"))).select(*usage.columns)
    tries = attempts.join(mine.select("_id"), F.col("job") == F.col("_id"), "left")
    ends = F.col("_id").isNotNull() & F.col("ended_at").isNull()
    tries = tries.withColumns({"ended_at": F.when(ends, as_of).otherwise(F.col("ended_at")), "outcome": F.when(ends, "lease_expired").otherwise(F.col("outcome"))}).select(*attempts.columns)
    begun = mine.select(F.col("_id").alias("job"), F.col("_token").alias("fencing_token"), F.lit(worker).alias("worker"), F.lit(None).cast("timestamp").alias("ended_at"), F.lit(None).cast("string").alias("outcome"))
    return after, spent, tries.unionByName(begun, allowMissingColumns=True)


def purged(artifacts: DataFrame, jobs: DataFrame) -> DataFrame:
    """The artifacts (job, artifact_key) that stay when jobs (id, status) have ended: of a canceled one the transcript and responses, of any other none; of open and unknown jobs all."""
    known = artifacts.join(jobs.select(F.col("id").alias("_id"), F.col("status").alias("_status")), F.col("job") == F.col("_id"), "left")
    paid = (F.col("artifact_key") == "transcript") | F.col("artifact_key").startswith("response:")
    stays = F.coalesce(F.col("_status").isin("queued", "running") | (F.col("_status") == "canceled") & paid, F.lit(True))
    return known.where(stays).select(*artifacts.columns)


def owns_lease(jobs: DataFrame, claims: DataFrame, *, as_of: Column) -> DataFrame:
    """claims with ``owned``: token and worker are the job's, which runs under a live lease."""
    j = jobs.select(F.col("id").alias("_id"), F.col("fencing_token").alias("_token"), F.col("worker").alias("_worker"), "status", "lease_until")
    ok = (F.col("fencing_token") == F.col("_token")) & (F.col("worker") == F.col("_worker")) & (F.col("status") == "running") & (F.col("lease_until") > as_of)
    return claims.join(j, claims["id"] == F.col("_id"), "left").select(*[claims[c] for c in claims.columns], F.coalesce(ok, F.lit(False)).alias("owned"))


def is_live(expires_at: Column, as_of: Column) -> Column:
    """A row without an expiry lives for ever."""
    return expires_at.isNull() | (expires_at > as_of)


def orphans(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """Children whose parent is missing; a null key refers to nothing and isn't one."""
    known = children.where(F.array_size(F.filter(F.array(*[F.col(c).cast("string") for c in on]), lambda x: x.isNull())) == 0)
    return known.join(parents.select(*on), on, "left_anti")


def violations(**rules: Column) -> Column:
    """The names of the rules that a row breaks; a rule whose value is unknown isn't broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(True)), F.lit(name)) for name, ok in rules.items()]))


def unknown_keys(json: Column, allowed: list[str]) -> Column:
    return F.array_except(F.json_object_keys(json), F.array(*[F.lit(k) for k in allowed]))


def contiguous(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    """Whether the positions of each key are 1..n."""
    w = Window.partitionBy(*keys).orderBy(position)
    return rows.withColumn("_n", F.row_number().over(w)).groupBy(*keys).agg(F.bool_and(F.col(position) == F.col("_n")).alias("contiguous"), F.count("*").alias("n"))


def context_budget(rows: DataFrame, keys: list[str], order: list[str], *, text: str = "text", most: int) -> DataFrame:
    """rows with what each keeps of its text when a key's texts share a budget of characters in order; none is left out."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.char_length(text)).over(before), F.lit(0))
    room = F.least(F.greatest(F.lit(0), F.lit(most) - used), F.char_length(text)).cast("int")
    kept = F.substring(F.col(text), F.lit(1), F.col("_room"))
    return rows.withColumn("_room", room).withColumns({"kept": kept, "original_chars": F.char_length(text), "truncated": F.col("_room") < F.char_length(text)}).drop("_room")


def collect_expired(rows: DataFrame, expires_at: str, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(rows that live on, rows that are collected). A table is replaced by the first; what is collected is known before."""
    live = is_live(F.col(expires_at), as_of)
    return rows.where(live), rows.where(~live)


def cascade(children: DataFrame, parents: DataFrame, on: list[str]) -> DataFrame:
    """The children whose parent is still there, after parents were deleted; a null key refers to nothing and stays."""
    loose = F.array_contains(F.array(*[F.col(c).isNull() for c in on]), True)
    return children.where(~loose).join(parents.select(*on).distinct(), on, "left_semi").select(*children.columns).unionByName(children.where(loose))


def merged(document: Column, patch: Column) -> Column:
    """A map with the entries of another put over its own."""
    kept = F.map_filter(document, lambda k, _: ~F.map_contains_key(patch, k))
    return F.map_concat(kept, patch)
