"""Request logs and sessions: limits, expiry, known paths, session lookup, audits, debounce, latest wins."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fixed_values import (DEBOUNCE_SECONDS, RATE_MAX_REQUESTS, RATE_WINDOW_SECONDS, STALE_KEY_BATCH,
                                      STALE_KEY_SECONDS)


def micros(ts) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))


def window_start(ts: str, seconds: float) -> Column:
    """Start of the fixed window a time lies in, in microseconds."""
    size = int(seconds * 1_000_000)
    return F.floor(micros(ts) / size) * size


def rate_windows(requests: DataFrame, window: float = RATE_WINDOW_SECONDS, limit: int = RATE_MAX_REQUESTS) -> DataFrame:
    """Requests, admitted and denied per key and window; partial counts, so a flooding key costs nothing extra."""
    return requests.groupBy("key", window_start("ts", window).alias("window_us")).agg(
        F.count(F.lit(1)).alias("requests")).withColumns({
            "admitted": F.least(F.col("requests"), F.lit(limit)),
            "denied": F.greatest(F.col("requests") - limit, F.lit(0))})


def rate_limit(requests: DataFrame, window: float = RATE_WINDOW_SECONDS, limit: int = RATE_MAX_REQUESTS) -> DataFrame:
    """Adds admitted to every request: the first ``limit`` of its key and window by (ts, event_id).

    Only the position of the last admitted request is needed. Requests beyond the limit are dropped per task
    before the ranking exchange, and the cutoffs are joined back, where a flooding key is split as skew.
    """
    marked = requests.withColumn("window_us", window_start("ts", window))
    order = Window.partitionBy("key", "window_us").orderBy("ts", "event_id")
    cutoffs = marked.select("key", "window_us", "ts", "event_id").withColumn(
        "place", F.row_number().over(order)).where(F.col("place") <= limit).where(F.col("place") == limit)
    cutoffs = cutoffs.select("key", "window_us", F.struct("ts", "event_id").alias("cutoff"))
    return marked.join(cutoffs, ["key", "window_us"], "left").withColumn(
        "admitted", F.col("cutoff").isNull() | (F.struct("ts", "event_id") <= F.col("cutoff"))).drop("cutoff", "window_us")


def limiter_rows(requests: DataFrame) -> DataFrame:
    """Counter table: requests and last request per key."""
    return requests.groupBy("key").agg(F.count(F.lit(1)).alias("count"), F.max("ts").alias("last_request"))


def expire_keys(counters: DataFrame, now: str, idle: float = STALE_KEY_SECONDS, batch: int = STALE_KEY_BATCH) -> DataFrame:
    """The keys one cleanup call removes: idle for longer than ``idle`` seconds, oldest first, one batch."""
    stale = counters.where(micros("last_request") < micros(F.lit(now)) - int(idle * 1_000_000))
    return stale.orderBy("last_request", "key").limit(batch)


def known_paths(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Requests to registered endpoints."""
    return requests.join(endpoints.select("path"), "path", "left_semi")


def path_report(requests: DataFrame, registered: Column) -> DataFrame:
    """Requests per path and whether any request registered it: one scan and one aggregation."""
    return requests.groupBy("path").agg(F.count(F.lit(1)).alias("requests"), F.coalesce(F.bool_or(registered), F.lit(False)).alias("known"))


def unknown_paths(requests: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Rejected requests, for the report."""
    return requests.join(endpoints.select("path"), "path", "left_anti")


def active_session_at(events: DataFrame, sessions: DataFrame, bucket: float = 86_400) -> DataFrame:
    """Newest session of the user that is valid at each event.

    Sessions are listed once per time bucket they cover and joined on user and bucket, so a user with very
    many events is spread over time and only sessions near the event are compared.
    """
    size = int(bucket * 1_000_000)
    slots = F.sequence(F.floor(micros("created") / size), F.floor((micros("expires") - 1) / size))
    spans = sessions.where(F.col("created") < F.col("expires")).select(
        "user_id", "session_id", "created", "expires", F.explode(slots).alias("slot"))
    marked = events.withColumn("slot", F.floor(micros("ts") / size))
    hits = marked.join(spans, ["user_id", "slot"]).where(
        (F.col("ts") >= F.col("created")) & (F.col("ts") < F.col("expires")))
    return hits.groupBy("event_id", "user_id", "ts").agg(
        F.max(F.struct("created", "session_id")).alias("s")).select(
        "event_id", "user_id", "ts", F.col("s.session_id").alias("session_id"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Key values that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Foreign keys without a parent and how many rows carry them. Keys are counted before the anti-join."""
    keys = child.where(F.col(child_key).isNotNull()).groupBy(child_key).agg(F.count(F.lit(1)).alias("n"))
    return keys.join(parent.select(F.col(parent_key).alias(child_key)), child_key, "left_anti")


def latest_wins(requests: DataFrame, *keys: str) -> DataFrame:
    """The newest request per key; a maximum with partial aggregation, not a ranked window."""
    rest = [c for c in requests.columns if c not in (*keys, "ts", "event_id")]
    return requests.groupBy(*keys).agg(F.max(F.struct("ts", "event_id")).alias("k"),
                                       F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("r")).select(
        *keys, "k.ts", "k.event_id", "r.*")


def accepted_origin(url) -> Column:
    """Normalised origin of an https (or loopback http) URL without path, query, fragment or credentials;
    null when the URL is not acceptable."""
    secure = F.regexp_extract(url, r"(?i)^https://([^/?#@\s:]+(?::\d+)?)/?$", 1)
    local = F.regexp_extract(url, r"(?i)^http://((?:127\.0\.0\.1|localhost|\[::1\])(?::\d+)?)/?$", 1)
    return (F.when(secure != "", F.concat(F.lit("https://"), F.regexp_replace(F.lower(secure), r":443$", "")))
            .when(local != "", F.concat(F.lit("http://"), F.regexp_replace(F.lower(local), r":80$", ""))))


# -- debounce --------------------------------------------------------------------------------------

def _whole_groups(batches: Iterator, by: list[str]) -> Iterator:
    """Arrow batches of a sorted stream, re-cut so that no group is split. Holds one batch and one open group."""
    import pandas as pd

    tail = None
    for pdf in batches:
        pdf = pdf if tail is None else pd.concat([tail, pdf], ignore_index=True)
        if not len(pdf):
            continue
        same = (pdf[by] == pdf[by].iloc[-1]).all(axis=1).to_numpy()
        cut = len(pdf) - int(same.sum())
        tail = pdf.iloc[cut:]
        if cut:
            yield pdf.iloc[:cut].reset_index(drop=True)
    if tail is not None and len(tail):
        yield tail.reset_index(drop=True)


def _chains(pdf, by: list[str], gap: int, size: int):
    """Group number, offset inside the chunk and next kept index (len = none) for sorted rows of many groups."""
    import numpy as np

    fresh = (pdf[by] != pdf[by].shift()).any(axis=1).to_numpy()
    group = np.cumsum(fresh) - 1
    offset = pdf["t"].to_numpy() - pdf["chunk"].to_numpy() * size
    line = group * (2 * size) + offset  # groups lie too far apart for a step to cross into the next one
    following = np.searchsorted(line, line + gap, side="left")
    ends = np.append(np.flatnonzero(fresh)[1:], len(pdf))[group]
    return fresh, group, offset, line, np.where(following < ends, following, len(pdf))


def debounce(events: DataFrame, key: str, seconds: float = DEBOUNCE_SECONDS, chunk_seconds: float = 3600.0) -> DataFrame:
    """Keep an event only when at least ``seconds`` passed since the last kept event of its key.

    What is kept depends on what was kept before, so a window cannot express it. Time is cut into chunks per
    key and three steps run: (1) every chunk, in parallel, states which kept event it ends with for each
    possible first kept event; (2) these short statements are chained per key; (3) every chunk is replayed
    with its true entry. A key with a third of all events is spread over its chunks; only chunk summaries are
    read in key order, as a stream. Steps work on sorted partitions, many chunks per array operation.
    """
    gap = int(seconds * 1_000_000)
    size = max(int(chunk_seconds * 1_000_000), 4 * gap)
    key_type, id_type = dict(events.dtypes)[key], dict(events.dtypes)["event_id"]
    base = events.select(key, "event_id", micros("ts").alias("t")).withColumn("chunk", F.floor(F.col("t") / size))
    by = [key, "chunk"]

    def summarise(batches):
        import numpy as np

        for pdf in _whole_groups(batches, by):
            fresh, group, offset, _, following = _chains(pdf, by, gap, size)
            here = np.arange(len(pdf))
            last = np.where(following < len(pdf), following, here)
            while True:
                jump = last[last]
                if np.array_equal(jump, last):
                    break
                last = jump
            # An event kept before the chunk can only decide between the events of the first gap and the next one.
            early = offset < gap
            entry = early | fresh | np.append(False, early[:-1] & (group[1:] == group[:-1]))
            rows = here[entry]
            final = last[rows]
            changes = np.append((final[1:] != final[:-1]) | (group[rows][1:] != group[rows][:-1]), True)
            out = pdf.loc[rows[changes], by].assign(upto=pdf["t"].to_numpy()[rows[changes]],
                                                    exit=pdf["t"].to_numpy()[final[changes]])
            yield out

    sized = base.select(*by, "t").repartition(*by).sortWithinPartitions(*by, "t")
    steps = sized.mapInPandas(summarise, f"{key} {key_type}, chunk long, upto long, exit long")

    def link(batches):
        import pandas as pd

        seen, chunk, held, entry = None, None, None, None
        for pdf in batches:
            rows = []
            for owner, number, upto, final in pdf[[*by, "upto", "exit"]].itertuples(index=False):
                if owner != seen:
                    seen, chunk, held = owner, None, None
                if number != chunk:
                    chunk, entry, open_chunk = number, held, True
                    rows.append((owner, number, entry))
                if open_chunk and (entry is None or upto >= entry + gap):
                    held, open_chunk = final, False
            if rows:
                yield pd.DataFrame(rows, columns=[*by, "held"]).astype({"held": "Int64"})

    ordered = steps.repartition(key).sortWithinPartitions(*by, "upto")
    entries = ordered.mapInPandas(link, f"{key} {key_type}, chunk long, held long")

    def replay(batches):
        import numpy as np

        for pdf in _whole_groups(batches, by):
            fresh, group, _, line, following = _chains(pdf, by, gap, size)
            first = np.flatnonzero(fresh)
            bound = np.append(first[1:], len(pdf))
            start = pdf["chunk"].to_numpy()[first] * size
            held = pdf["held"].astype("Int64").fillna(np.iinfo(np.int64).min).to_numpy(np.int64)[first]
            wait = np.where(held > start - gap, held - start + gap, 0)  # time into the chunk before one may be kept
            at = np.searchsorted(line, group[first] * (2 * size) + wait, side="left")
            at = at[(at < bound)]
            kept = np.zeros(len(pdf), bool)
            while len(at):
                kept[at] = True
                at = following[at]
                at = at[at < len(pdf)]
            yield pdf.loc[kept, [key, "event_id"]]

    ready = base.join(entries, by).repartition(*by).sortWithinPartitions(*by, "t", "event_id")
    return ready.mapInPandas(replay, f"{key} {key_type}, event_id {id_type}")
