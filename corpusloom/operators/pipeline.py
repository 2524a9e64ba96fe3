"""Pipeline mechanics as tables: shards, upserts, skips, status moves, layers, requests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from .ranges import numbered, numbered_within


def shards(df: DataFrame, order: str, size: int) -> DataFrame:
    """df with shard_id `%04d` from 1, `size` rows each in order. Rows are numbered by range, so no task sees them all."""
    return numbered(df, [order], "__at").withColumn("shard_id", F.format_string("%04d", F.ceil(F.col("__at") / size))).drop("__at")


def shard_manifest(sharded: DataFrame, line: str, order: str) -> DataFrame:
    """(shard_id, n, bytes, sha256) of each shard's lines joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(order, line)))
    body = F.concat(F.array_join(F.transform(rows, lambda r: r[line]), "\n"), F.lit("\n"))
    one = sharded.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"), body.alias("__body"))
    return one.select("shard_id", "n", F.octet_length("__body").cast("long").alias("bytes"), F.sha2("__body", 256).alias("sha256"))


def slug_files(df: DataFrame, label: str, order: str) -> DataFrame:
    """df with `slug`; of labels with one slug the second gets `-2`, the third `-3`, in order."""
    s = numbered_within(df.withColumn("__s", slug(label, "-")), ["__s"], [order], "__n")  # a slug may have any number of labels
    return s.withColumn("slug", F.when(F.col("__n") > 1, F.concat("__s", F.lit("-"), F.col("__n").cast("string"))).otherwise(F.col("__s"))).drop("__s", "__n")


def upsert(existing: DataFrame, incoming: DataFrame, key: str, order: str) -> DataFrame:
    """All keys, the row of the greatest order for each; incoming rows win ties."""
    both = existing.withColumn("__new", F.lit(0)).unionByName(incoming.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(order), F.desc("__new"))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__new")


def unchanged_skipped(df: DataFrame, key: str, content: str, stored: DataFrame, stored_hash: str = "sha256") -> DataFrame:
    """Rows whose content hash isn't stored for their key, with that hash."""
    s = stored.select(F.col(key).alias("__k"), F.col(stored_hash).alias("__h"))
    hashed = df.withColumn("sha256", F.sha2(F.col(content).cast("string"), 256))
    return hashed.join(s, (F.col(key) == F.col("__k")) & (F.col("sha256") == F.col("__h")), "left_anti")


def transition(queue: DataFrame, done: DataFrame, key: str, source: str, target: str, status: str = "status") -> DataFrame:
    """queue with the rows of `done` moved from one status to the next."""
    d = done.select(F.col(key).alias("__k")).distinct()
    both = queue.join(d, queue[key] == F.col("__k"), "left")
    return both.withColumn(status, F.when((F.col(status) == source) & F.col("__k").isNotNull(), target).otherwise(F.col(status))).drop("__k")


def admitted(jobs: DataFrame, order: str, active: Sequence[str], most: int, status: str = "status") -> DataFrame:
    """Waiting jobs that may start: the first in order, as many as active ones leave free. Only the first `most` are ever numbered."""
    busy = jobs.agg(F.count_if(F.col(status).isin(*active)).alias("__busy"))
    waiting = jobs.where(F.col(status) == "prepared").orderBy(order).limit(most).withColumn("__n", F.row_number().over(Window.orderBy(order)))
    return waiting.join(F.broadcast(busy)).where(F.col("__n") + F.col("__busy") <= most).drop("__n", "__busy")


def queue_scan(queue: DataFrame, statuses: Sequence[str], ids: Sequence | None = None, source: str | None = None, limit: int | None = None, key: str = "id") -> DataFrame:
    out = queue.where(F.col("status").isin(*statuses))
    out = out.where(F.col(key).isin(*ids)) if ids else out
    out = out.where(F.col("source") == source) if source else out
    return out.orderBy(key).limit(limit) if limit else out.orderBy(key)


def layered(df: DataFrame, layers: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """df with `layer` and `decision`: of the first layer (name, condition, decision) whose condition holds, else unmapped."""
    layer, decision = F.lit("none"), F.lit("unmapped")
    for name, condition, value in reversed(layers):
        layer = F.when(condition, name).otherwise(layer)
        decision = F.when(condition, value).otherwise(decision)
    return df.withColumn("layer", layer).withColumn("decision", decision)


def requests(df: DataFrame, key: str, model: str, template: str, fields: Sequence[str]) -> DataFrame:
    """(custom_id, method, url, body): request lines from a template; calling a model is out of scope."""
    prompt = F.format_string(template, *[F.col(c) for c in fields])
    body = F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("input")))
    return df.select(F.col(key).cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body"))


def same_reviewer(df: DataFrame, drafter: str, reviewer: str) -> DataFrame:
    """Rows that break the rule that who reviews didn't draft."""
    return df.where(F.col(drafter) == F.col(reviewer))


def freshness(df: DataFrame, group: str, stamp: str) -> DataFrame:
    """(group, version): count and latest stamp, by which a reader sees whether a source has changed."""
    return df.groupBy(group).agg(F.concat_ws(":", F.count(F.lit(1)).cast("string"), F.max(stamp).cast("string")).alias("version"))


# Answers that are tried again, and the states of a job that takes a place.
RETRYABLE = (408, 409, 429, 500, 502, 503, 504)
ACTIVE = ("submitted", "validating", "in_progress", "finalizing", "cancelling")


def retries(attempts: DataFrame, code: str, attempt: str, most: int, hint: str | None = None, top: int = 60) -> DataFrame:
    """attempts with `decision` (ok, retry, error) and `delay`: seconds to wait before the next, 2 to the power of the attempt, `top` at most.

    A wait that the server names (hint) goes before. The jitter is left to the caller.
    """
    ok = F.col(code).between(200, 299)
    again = F.col(code).isin(*RETRYABLE) & (F.col(attempt) <= most)
    own = F.least(F.pow(F.lit(2.0), F.col(attempt)), F.lit(float(top)))
    wait = F.when(F.col(hint) > 0, F.col(hint).cast("double")).otherwise(own) if hint else own
    decision = F.when(ok, "ok").when(again, "retry").otherwise("error")
    return attempts.withColumn("decision", decision).withColumn("delay", F.when(decision == "retry", wait))


def job_decisions(shards: DataFrame, order: str, most: int | None = None, retry_failed: bool = False, force: bool = False, status: str = "status", batch: str = "batch_id") -> DataFrame:
    """shards with `decision`: skip (it has a batch already), create, or defer (no place free for it), in order.

    A failed one is created again if retry_failed; force creates all. Created ones take the places that
    active ones leave of `most`; where none are left the rest is deferred.
    """
    has = F.col(batch).isNotNull() & F.lit(not force)
    if retry_failed:
        has = has & (F.col(status) != "failed")
    named = shards.withColumn("__skip", F.coalesce(has, F.lit(False)))
    if most is None:
        return named.withColumn("decision", F.when(F.col("__skip"), "skip").otherwise("create")).drop("__skip")
    busy = shards.agg(F.count_if(F.col(status).isin(*ACTIVE)).alias("__busy"))
    numbers = numbered(named, ["__skip", order], "__n")  # those not skipped first, in order
    free = F.greatest(F.lit(most) - F.col("__busy"), F.lit(0))
    out = numbers.join(F.broadcast(busy))  # one row
    return out.withColumn("decision", F.when(F.col("__skip"), "skip").when(F.col("__n") <= free, "create").otherwise("defer")).drop("__skip", "__n", "__busy")


def polled(history: DataFrame, job: str, time: str, status: str = "status", terminal: Sequence[str] = ("completed", "failed", "expired", "cancelled")) -> DataFrame:
    """(job, status, at, polls): what a poll loop that ends at a job's first terminal state has seen: that state, or the last one, and how many polls."""
    end = F.col(status).isin(*terminal)
    seen = history.groupBy(job).agg(F.min(F.when(end, F.struct(time, status))).alias("__end"), F.max(F.struct(time, status)).alias("__last"))
    both = history.join(seen.withColumnRenamed(job, "__j"), F.col(job) == F.col("__j"))
    counted = both.where(F.col("__end").isNull() | (F.col(time) <= F.col("__end").getField(time)))
    last = F.coalesce("__end", "__last")
    return counted.groupBy(job, last.alias("__s")).agg(F.count(F.lit(1)).alias("polls")).select(job, F.col("__s").getField(status).alias("status"), F.col("__s").getField(time).alias("at"), "polls")


def _request(key: Column, model: str, prompt: Column, extra: dict | None = None) -> list[Column]:
    body = F.to_json(F.struct(F.lit(model).alias("model"), prompt.alias("input"), *[F.lit(v).alias(k) for k, v in (extra or {}).items()]))
    return [key.alias("custom_id"), F.lit("POST").alias("method"), F.lit("/v1/responses").alias("url"), body.alias("body")]


def opening_requests(
    texts: DataFrame, done: DataFrame, path: str, text: str, metadata: Sequence[str], model: str, template: str, label: str, lines: int = 60, chars: int = 4000, extra: dict | None = None
) -> DataFrame:
    """A request for each text whose path isn't among done (path): the template takes its metadata and its opening, the first `lines` lines cut at `chars`.

    extra are further members of the body. custom_id is the label and a slug of the path, in `path` the path itself; a null text has an empty opening.
    """
    have = done.select(F.col(path).alias("__p")).distinct()
    rest = texts.join(have, F.col(path) == F.col("__p"), "left_anti")
    opening = F.substring(F.array_join(F.slice(F.split(F.coalesce(text, F.lit("")), "\n"), 1, lines), "\n"), 1, chars)
    prompt = F.format_string(template, *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in metadata], opening)
    custom = F.concat_ws(":", F.lit(label), slug(path))
    return rest.select(*_request(custom, model, prompt, extra), F.col(path).alias("path"))


def review_requests(drafts: DataFrame, custom_id: str, status: str, draft: str, rubric: str, model: str, template: str, chars: int = 14_000, extra: dict | None = None) -> DataFrame:
    """A request for each completed, non-blank draft: the template takes the rubric and the draft's first `chars` characters. source_custom_id leads back to the draft."""
    kept = drafts.where((F.col(status) == "completed") & (F.trim(draft) != ""))
    prompt = F.format_string(template, F.lit(rubric), F.substring(draft, 1, chars))
    return kept.select(*_request(F.concat(F.lit("review:"), F.col(custom_id).cast("string")), model, prompt, extra), F.col(custom_id).alias("source_custom_id"))


def image_prompts(seen: DataFrame, related: DataFrame, subject: str, others: str, places: str, least: int = 2, most: int = 200) -> DataFrame:
    """(key, out, prompt): a prompt for each key seen in `least` places or more, of a sentence on the key, one on what is related, if anything, and one on the places.

    seen is (key, place), related (key, other), both distinct; of either the first `most` by name are listed. out is the key's file.
    """

    def listed(df: DataFrame, column: str, name: str) -> DataFrame:
        first = df.withColumn("__r", F.row_number().over(Window.partitionBy("key").orderBy(column))).where(F.col("__r") <= most)
        return first.groupBy(F.col("key").alias(f"__{name}")).agg(F.array_join(F.array_sort(F.collect_list(column)), ", ").alias(name))

    often = seen.groupBy("key").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("key")
    both = often.join(listed(seen, "place", "places"), F.col("key") == F.col("__places")).join(listed(related, "other", "others"), F.col("key") == F.col("__others"), "left")
    more = F.coalesce(F.format_string(others, "others"), F.lit(""))
    more = F.when(F.col("others").isNotNull(), more).otherwise("")
    return both.select("key", F.concat(slug("key", "-"), F.lit(".png")).alias("out"), F.concat(F.format_string(subject, "key"), more, F.format_string(places, "places")).alias("prompt"))


def pair_requests(edges: DataFrame, a: str, b: str, profiles: DataFrame, key: str, profile: str, model: str, template: str) -> DataFrame:
    """Requests that compare the two ends of each edge: the template takes both keys and both profiles, in the order a, its profile, b, its profile."""
    p = profiles.groupBy(key).agg(F.max(profile).alias(profile))
    pa, pb = (p.select(F.col(key).alias(f"__{s}"), F.col(profile).alias(f"__p{s}")) for s in "ab")
    both = edges.join(pa, F.col(a) == F.col("__a")).join(pb, F.col(b) == F.col("__b"))
    custom = F.concat_ws(":", F.lit("edge"), F.col(a).cast("string"), F.col(b).cast("string"))
    return both.select(*_request(custom, model, F.format_string(template, F.col(a), F.col("__pa"), F.col(b), F.col("__pb"))))


def group_requests(df: DataFrame, group: str, child: str, order: Sequence[Column | str], model: str, template: str, label: str = "group", least: int = 1, most: int = 200) -> DataFrame:
    """One request for each group of `least` children or more: the template takes the group, its number of children and the first `most` of them, a line each."""
    n = df.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    first = df.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= most)
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", F.col(child).cast("string").alias("__c")))), lambda r: F.concat(F.lit("- "), r["__c"])), "\n")
    both = first.groupBy(group).agg(listed.alias("__l")).join(n, F.col(group) == F.col("__g"))
    custom = F.concat_ws(":", F.lit(label), F.col(group).cast("string"))
    return both.select(*_request(custom, model, F.format_string(template, F.col(group), F.col("__n"), F.col("__l"))))


def table_request(df: DataFrame, columns: Sequence[str], order: Sequence[Column | str], model: str, template: str, custom_id: str, most: int = 500) -> DataFrame:
    """One request over the first `most` rows of a table, a line of its columns each: the template takes their number and the lines."""
    top = df.orderBy(*order).limit(most).select(F.concat_ws(" | ", *[F.col(c).cast("string") for c in columns]).alias("__line"), *[F.col(c) for c in columns])
    ranks = top.withColumn("__r", F.row_number().over(Window.orderBy(*order)))  # `most` rows
    lines = ranks.agg(F.count(F.lit(1)).alias("__n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__r", "__line"))), lambda r: r["__line"]), "\n").alias("__l"))
    return lines.select(*_request(F.lit(custom_id), model, F.format_string(template, F.col("__n"), F.col("__l"))))
