"""Operators on ordered events: sessions, windows, exchanges, turn clusters, packing by budget."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.text import asks
from tracewell.functions.times import seconds_between

# Kinds of tools, and gaps in seconds after which a cluster of turns ends for sure or perhaps.
ACTION_TOOLS = ["Bash", "Write", "Edit", "NotebookEdit"]
PLUMBING_TOOLS = [
    "Skill", "ScheduleWakeup", "TaskCreate", "TaskUpdate", "TaskGet", "TaskList", "TaskStop", "TaskOutput", "Monitor", "CronCreate",
    "CronDelete", "CronList", "ExitPlanMode", "EnterPlanMode", "PushNotification", "RemoteTrigger", "EnterWorktree", "ExitWorktree",
]
HARD_GAP, SOFT_GAP, MAX_CLUSTER = 7200, 1800, 8


def gap_sessions(events: DataFrame, key: str, ts: str, order: list[str], gap_seconds: int = 1800) -> DataFrame:
    """``events`` with ``session_no``, from 0 per key: a new session where the gap to the event before exceeds the limit.

    A gap of exactly the limit stays in the session. Rows without key or time are dropped. ``order`` breaks ties of time.
    Rows are walked by key and day, so a key with a third of all rows is spread over its days; the days of a key are
    then chained by their first and last times.
    """
    rows = events.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__day", F.date_trunc("day", ts).cast("date"))
    w = Window.partitionBy(key, "__day").orderBy(ts, *order)
    new = F.coalesce((seconds_between(F.lag(ts).over(w), F.col(ts)) > gap_seconds).cast("long"), F.lit(0).cast("long"))
    rows = rows.withColumn("__new", new).withColumn("__local", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    days = rows.groupBy(key, "__day").agg(F.min(ts).alias("__first"), F.max(ts).alias("__last"), F.sum("__new").alias("__n"))
    chain = Window.partitionBy(key).orderBy("__day")
    opens = F.coalesce((seconds_between(F.lag("__last").over(chain), F.col("__first")) > gap_seconds).cast("long"), F.lit(0).cast("long"))
    days = days.withColumn("__open", opens).withColumn("__base", F.sum(F.col("__open") + F.col("__n")).over(chain.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__n"))
    out = rows.join(days.select(key, "__day", "__base"), [key, "__day"]).withColumn("session_no", F.col("__base") + F.col("__local"))
    return out.select(*events.columns, "session_no")


def session_provenance(sessions: DataFrame, key: str, ts: str, kind: str, error: Column, trigger: Column) -> DataFrame:
    """Per session: events, first and last time, minutes (1 digit), distinct kinds in order, errors, first trigger."""
    return sessions.groupBy(key, "session_no").agg(
        F.count("*").alias("n_events"), F.min(ts).alias("time_first"), F.max(ts).alias("time_last"),
        F.array_sort(F.collect_set(kind)).alias("kinds"), F.bool_or(error).alias("had_error"), F.count_if(error).alias("error_count"),
        F.min_by(F.substring(trigger, 1, 200), F.struct(ts, trigger)).alias("trigger"),
    ).withColumn("minutes", F.round(seconds_between(F.col("time_first"), F.col("time_last")) / 60, 1))


def sliding_windows(rows: DataFrame, key: str, order: list[str], value: str, n: int) -> DataFrame:
    """(key, window_no, values): every run of n consecutive rows of a key; max(0, rows - n + 1) windows."""
    w = Window.partitionBy(key).orderBy(*order)
    out = rows.select(key, (F.row_number().over(w) - 1).alias("window_no"), F.collect_list(value).over(w.rowsBetween(0, n - 1)).alias("values"))
    return out.filter(F.size("values") == n)


def exchanges(rows: DataFrame, key: str, seq: str, role: str, text: str) -> DataFrame:
    """(key, seq, user_text, assistant_text): a user row followed at once by an assistant row; others are dropped."""
    w = Window.partitionBy(key).orderBy(seq)
    nxt = rows.withColumn("__r", F.lead(role).over(w)).withColumn("__t", F.lead(text).over(w))
    return nxt.filter((F.col(role) == "user") & (F.col("__r") == "assistant")).select(key, seq, F.col(text).alias("user_text"), F.col("__t").alias("assistant_text"))


def retry_flags(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``events`` with ``is_retry``: the same keys occurred earlier."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return events.withColumn("is_retry", F.row_number().over(w) > 1)


def budget_prefix(rows: DataFrame, key: str, order: list[str], text: str, budget: int) -> DataFrame:
    """Rows of a key from the first on while their characters, one added per row, stay within the budget; stops at the
    first that does not fit. Null texts count as empty. A row costs at least one, so no more than ``budget`` rows of a
    key are kept before the shuffle."""
    o = Window.partitionBy(key).orderBy(*order)
    w = o.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__r", F.row_number().over(o)).filter(F.col("__r") <= budget).drop("__r")
    return rows.withColumn("used", F.sum(F.length(F.coalesce(text, F.lit(""))) + 1).over(w)).filter(F.col("used") <= budget)


def noise_filter(turns: DataFrame, key: str, ts: str, order: list[str], error: str, tools: str, loops: str, response: str) -> DataFrame:
    """Turns worth keeping: with an error or an action tool; not all plumbing; two loops; talk with over 100 characters
    of answer; and turns that only look around if one of the next four within the soft gap acts or fails.

    The look ahead stops at the first gap that is too large. Null tools count as none.
    """
    w = Window.partitionBy(key).orderBy(ts, *order)
    used = F.coalesce(F.col(tools), F.array().cast("array<string>"))
    acts = F.coalesce(F.arrays_overlap(used, F.array(*map(F.lit, ACTION_TOOLS))), F.lit(False))
    rows = turns.withColumn("__live", F.coalesce(F.col(error), F.lit(False)) | acts)
    ahead, near = F.lit(False), F.lit(True)
    for k in range(1, 5):
        near = near & F.coalesce(seconds_between(F.col(ts), F.lead(ts, k).over(w)) <= SOFT_GAP, F.lit(False))
        ahead = ahead | (near & F.coalesce(F.lead("__live", k).over(w), F.lit(False)))
    plumbing = F.size(F.array_except(used, F.array(*map(F.lit, PLUMBING_TOOLS)))) == 0
    keep = F.when(F.col("__live"), True).when((F.size(used) > 0) & plumbing, False).when(F.coalesce(F.col(loops), F.lit(0)) >= 2, True)
    keep = keep.when(F.size(used) == 0, F.length(F.coalesce(F.col(response), F.lit(""))) > 100).otherwise(F.col("__ahead"))
    return rows.withColumn("__ahead", ahead).withColumn("__keep", keep).filter("__keep").drop("__live", "__ahead", "__keep")


def assemble_turns(messages: DataFrame, key: str, seq: str, role: str, text: str, skip: Column | None = None) -> DataFrame:
    """(key, turn_n, user_text, response, blocks): a user text opens a turn, assistant rows fold into it; rows before
    the first user text and rows of other roles are left out, as are those for which ``skip`` holds (results of tools that
    come under the user's role, meta rows)."""
    w = Window.partitionBy(key).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    if skip is not None:
        messages = messages.filter(~F.coalesce(skip, F.lit(False)))
    rows = messages.filter(F.col(role).isin("user", "assistant")).withColumn("turn_n", F.sum((F.col(role) == "user").cast("int")).over(w)).filter("turn_n > 0")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(role) == "assistant", F.struct(F.col(seq), F.col(text))))), lambda s: s[text]), "\n")
    return rows.groupBy(key, "turn_n").agg(F.max(F.when(F.col(role) == "user", F.col(text))).alias("user_text"), said.alias("response"), F.count_if(F.col(role) == "assistant").alias("blocks"))


def post_clear(sessions: DataFrame, key: str, started: str, ended: str, limit: int = 120) -> DataFrame:
    """``sessions`` with ``post_clear``: the session of the same key before it ended at most ``limit`` seconds earlier."""
    w = Window.partitionBy(key).orderBy(started)
    gap = seconds_between(F.lag(ended).over(w), F.col(started))
    return sessions.withColumn("post_clear", F.coalesce((gap >= 0) & (gap <= limit), F.lit(False)))


def cluster_step(state: dict | None, row: dict) -> tuple[bool, bool]:
    """(new cluster, the old one is closed for sure) for the next turn of a key; state is the open cluster.

    The intent is compared with that of the turn just before, and a turn without one changes nothing; the overlap is
    the share of the turn's own things that the cluster has, a half where either has none."""
    if state is None:
        return True, True
    gap = (row["ts"] - state["last"]).total_seconds()
    if gap > HARD_GAP:
        return True, True
    a, b = state["intent"], row["intent"]
    if a and b and a[:60] != b[:60]:
        return True, False
    if gap > SOFT_GAP:
        mine, other = set(row["things"]), state["things"]
        overlap = len(mine & other) / len(mine) if mine and other else 0.5
        if overlap < 0.3:
            return True, False
    return (True, True) if state["size"] >= MAX_CLUSTER else (False, False)


def _cluster(rows: list[dict]) -> Iterator[int]:
    """The cluster number of each row of one piece, in order of time."""
    clusters: list[dict] = []
    state, member = None, []
    for row in rows:
        row["things"] = [t for t in (row["things"] if row["things"] is not None else []) if t is not None]
        row["intent"] = (row["intent"] or "").strip()[:80]
        new, closed = cluster_step(state, row)
        if new:
            if state is not None:
                state["closed"] = closed
            state = {"first": row["ts"], "things": set(), "size": 0, "closed": False, "intent": ""}
            clusters.append(state)
        state["last"], state["size"] = row["ts"], state["size"] + 1
        state["things"] |= set(row["things"])
        state["intent"] = row["intent"]
        member.append(len(clusters) - 1)
    # neighbours are merged where the earlier one ended provisionally, soon before, with a thing in common
    home = list(range(len(clusters)))
    kept = 0
    for k in range(1, len(clusters)):
        a, b = clusters[home[k - 1]], clusters[k]
        gap = (b["first"] - a["last"]).total_seconds()
        if not a["closed"] and gap <= SOFT_GAP and (not a["things"] or not b["things"] or a["things"] & b["things"]):
            home[k] = home[k - 1]
            a["last"], a["closed"] = b["last"], b["closed"]
            a["things"] |= b["things"]
        else:
            kept += 1
            home[k] = k
    names = {h: i for i, h in enumerate(dict.fromkeys(home))}
    yield from (names[home[m]] for m in member)


def turn_clusters(turns: DataFrame, key: str, ts: str, order: list[str], intent: str, things: str) -> DataFrame:
    """``turns`` with ``cluster_no`` per key, by a running state no window function can hold: a cluster ends after a hard
    gap, when the intent changes, after a soft gap with little in common since its start, or when it is full;
    neighbours that ended provisionally are then merged.

    A cluster never spans a hard gap, so the input is first cut there by a window; pieces are spread over tasks and walked
    in sorted order, so neither a busy key nor very many small pieces hold a task up.
    """
    pieces = gap_sessions(turns, key, ts, order, HARD_GAP).withColumnRenamed("session_no", "__piece")
    schema = pieces.withColumn("cluster_no", F.lit(0).cast("long")).schema

    def numbered(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"ts": t, "intent": i, "things": x} for t, i, x in zip(pdf[ts], pdf[intent], pdf[things], strict=True)]
        at = pdf[[key, "__piece"]].ne(pdf[[key, "__piece"]].shift()).any(axis=1).to_numpy().nonzero()[0].tolist() + [len(pdf)]
        return pdf.assign(cluster_no=[c for lo, hi in zip(at[:-1], at[1:], strict=True) for c in _cluster(rows[lo:hi])])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in frames:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if not len(pdf):
                continue
            same = (pdf[key] == pdf[key].iloc[-1]) & (pdf["__piece"] == pdf["__piece"].iloc[-1])
            done, rest = pdf[~same], pdf[same].reset_index(drop=True)
            if len(done):
                yield numbered(done.reset_index(drop=True))
        if rest is not None:
            yield numbered(rest)

    local = pieces.repartition(key, "__piece").sortWithinPartitions(key, "__piece", ts, *order).mapInPandas(run, schema)
    last = local.groupBy(key, "__piece").agg((F.max("cluster_no") + 1).alias("__n"))
    start = last.withColumn("__start", F.coalesce(F.sum("__n").over(Window.partitionBy(key).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    return local.join(start, [key, "__piece"]).withColumn("cluster_no", F.col("cluster_no") + F.col("__start")).drop("__piece", "__start")


def token_chunks(rows: DataFrame, key: str, seq: str, tokens: str, target: int = 400, overlap: int = 80) -> DataFrame:
    """(key, chunk_no, seqs, tokens): greedy chunks of whole items up to ``target`` tokens; the next chunk starts with the
    last items of the one before, up to ``overlap`` tokens. An item larger than the target is a chunk of its own.

    A chunk depends on all chunks before it, so the items of a key are walked in order, by one task; they stream through
    it, and only the open chunk is held.
    """
    kind = rows.schema[key].dataType.simpleString()
    items = rows.select(F.col(key).alias("k"), F.col(seq).cast("long").alias("s"), F.coalesce(F.col(tokens), F.lit(0)).cast("long").alias("t"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        missing = object()
        now, no, open_, fresh, total = missing, 0, [], 0, 0
        for pdf in frames:
            out: list[tuple] = []
            for k, s, t in pdf.itertuples(index=False):
                k = None if k is None or k != k else k
                if now is missing or k != now:
                    if open_:
                        out.append((now, no, [i for i, _ in open_], total))
                    now, no, open_, fresh, total = k, 0, [], 0, 0
                if open_ and fresh and total + t > target:
                    out.append((now, no, [i for i, _ in open_], total))
                    no, fresh = no + 1, 0
                    tail, room, at = [], overlap, len(open_)
                    while at:
                        at -= 1
                        if open_[at][1] <= room:
                            tail.insert(0, open_[at])
                            room -= open_[at][1]
                    used = sum(x for _, x in tail)
                    open_, total = (tail, used) if used + t <= target else ([], 0)
                open_, fresh, total = [*open_, (s, t)], fresh + 1, total + t
            if out:
                yield pd.DataFrame(out, columns=["k", "chunk_no", "seqs", "tokens"])
        if open_:
            yield pd.DataFrame([(now, no, [i for i, _ in open_], total)], columns=["k", "chunk_no", "seqs", "tokens"])

    walked = items.repartition("k").sortWithinPartitions("k", "s", "t").mapInPandas(run, f"k {kind}, chunk_no int, seqs array<long>, tokens long")
    return walked.withColumnRenamed("k", key)


def sequence_numbers(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``seq``, from 1 per key; the last of a key is also its number of rows. ``order`` should end in a unique column."""
    return rows.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def significant(size: Column, error: Column, acted: Column) -> Column:
    """Whether a cluster is worth keeping: two turns or more, or one that failed or acted; nulls count as false."""
    return (size >= 2) | ((size == 1) & (F.coalesce(error, F.lit(False)) | F.coalesce(acted, F.lit(False))))


def provenance(rows: DataFrame, key: list[str], ts: str, order: list[str], lists: list[str], error: Column, trigger: Column) -> DataFrame:
    """Per key: ``source_count``, ``time_first``, ``time_last``, ``duration_s`` (1 digit), for each column of ``lists`` its distinct
    values in the order they first occur, ``had_errors``, ``retry_count`` and ``trigger``, the first text that is not blank (200
    characters). Null values are in no list. A list is taken from the first place of each value, not from all rows."""
    first = F.struct(F.col(ts), *order)
    said = F.trim(trigger)
    one = rows.groupBy(*key).agg(
        F.count("*").alias("source_count"), F.min(ts).alias("time_first"), F.max(ts).alias("time_last"), F.coalesce(F.bool_or(error), F.lit(False)).alias("had_errors"), F.count_if(error).alias("retry_count"),
        F.coalesce(F.min_by(F.substring(said, 1, 200), F.when(said != "", first)), F.lit("")).alias("trigger"),
    )
    one = one.withColumn("duration_s", F.round(seconds_between(F.col("time_first"), F.col("time_last")), 1))
    for c in lists:
        seen = rows.filter(F.col(c).isNotNull()).groupBy(*key, c).agg(F.min(first).alias("f")).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("f", F.col(c).alias("v")))), lambda s: s["v"]).alias(c))
        one = one.join(seen, key, "left").withColumn(c, F.coalesce(c, F.array()))
    return one


def question_windows(rows: DataFrame, key: str, seq: str, role: str, text: str, n: int) -> DataFrame:
    """(key, window_no) of the runs of n rows of a key (window_no from 0) in which a user's row asks something."""
    w = Window.partitionBy(key).orderBy(seq)
    asked = F.bool_or((F.col(role) == "user") & asks(F.col(text))).over(w.rowsBetween(0, n - 1))
    full = F.count("*").over(w.rowsBetween(0, n - 1)) == n
    out = rows.select(key, (F.row_number().over(w) - 1).alias("window_no"), asked.alias("__a"), full.alias("__f"))
    return out.filter("__a and __f").select(key, "window_no")


def fresh_or_missed(rows: DataFrame, cursor: DataFrame, ts: str, done: DataFrame, key: str) -> DataFrame:
    """Rows later than the cursor (one row, ``cursor``), or, if there are none, those no row of ``done`` (key) refers to, which the
    cursor has missed."""
    at = rows.join(F.broadcast(cursor.select("cursor"))).withColumn("__new", F.coalesce(F.col(ts) > F.col("cursor"), F.col("cursor").isNull()))
    some = at.agg(F.coalesce(F.bool_or("__new"), F.lit(False)).alias("__some"))
    hit = done.select(key).distinct().withColumn("__done", F.lit(True))
    out = at.join(F.broadcast(some)).join(hit, key, "left")
    return out.filter(F.when(F.col("__some"), F.col("__new")).otherwise(F.col("__done").isNull())).select(*rows.columns)
