"""Runtime guard: chat messages are judged by the same rules, in batch or as a stream with state for each conversation; and watched files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palisade.functions.spread import spread
from palisade.operators.extract import extract_prompts
from palisade.operators.findings import findings, raw_matches, with_points
from palisade.operators.scoring import capped, label, label_of
from palisade.operators.suppress import marks_of
from palisade.rules.catalogue import RULES, select
from palisade.rules.model import Rule, js_trim


@dataclass(frozen=True)
class Policy:
    """What a finding of each severity does; only `block` changes the decision."""

    actions: dict[str, str] = field(default_factory=dict)
    block_threshold: int | None = None
    min_confidence: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def rules(self, extra: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
        return select(self.include, self.exclude, self.min_confidence, (*RULES, *extra))


class Blocked(Exception):
    """Raised by wrap() when the policy blocks a conversation."""

    def __init__(self, conversation, score):
        super().__init__(f"conversation {conversation} blocked with score {score}")
        self.conversation, self.score = conversation, score


def flat_text(parts) -> F.Column:
    """Text of content parts (array of struct type, text): the text parts, a line each."""
    kept = F.filter(parts, lambda p: (p["type"] == "text") & p["text"].isNotNull())
    return F.array_join(F.transform(kept, lambda p: p["text"]), "\n")


def message_prompts(messages: DataFrame, hint: str = "ts", every: bool = False) -> DataFrame:
    """Two prompts a message that is not blank: as it is, and as code. Texts are not normalised.

    every: blank messages have theirs too, with a null text."""
    src = spread(messages).select("conv_id", "idx", "role", F.coalesce("text", F.lit("")).alias("text"))
    blank = js_trim(F.col("text")) == ""
    src = src.withColumn("text", F.when(~blank, F.col("text"))) if every else src.where(~blank)
    kinds = F.posexplode(F.array(F.lit("raw"), F.lit("code-block"))).alias("prompt_ord", "kind")
    last = F.size(F.split("text", "\n", -1))
    path = F.concat(F.lit("_message_"), F.col("idx").cast("string"), F.lit(f".{hint}"))
    return src.select("conv_id", "idx", "role", path.alias("path"), F.lit(f".{hint}").alias("ext"), kinds, "text", F.lit(1).alias("line_start"), last.alias("line_end"))


def inspect(messages: DataFrame, policy: Policy | None = None, hint: str = "ts", extra: tuple[Rule, ...] = ()) -> DataFrame:
    """Findings of messages (conv_id, idx, role, text)."""
    return findings(message_prompts(messages, hint), (policy or Policy()).rules(extra), ("conv_id", "idx", "role"))


def decisions(messages: DataFrame, policy: Policy | None = None, hint: str = "ts", extra: tuple[Rule, ...] = ()) -> DataFrame:
    """(conv_id, n_findings, score, score_label, blocked) of every conversation."""
    found = inspect(messages, policy, hint, extra)
    stops = [s for s, a in (policy.actions if policy else {}).items() if a == "block"]
    per = found.groupBy("conv_id").agg(F.count("*").alias("n_findings"), F.sum("risk_points").alias("s"), F.bool_or(F.col("severity").isin(*stops)).alias("stop"))
    all_ = messages.select("conv_id").distinct().join(per, "conv_id", "left")
    score = capped(F.col("s"))
    over = F.lit(False) if policy is None or policy.block_threshold is None else score >= policy.block_threshold
    return all_.select("conv_id", F.coalesce("n_findings", F.lit(0)).alias("n_findings"), score.alias("score"), label(score).alias("score_label"), (over | F.coalesce("stop", F.lit(False))).alias("blocked"))


def wrap(messages: DataFrame, policy: Policy, call: Callable, on_inspect: Callable[[DataFrame], None] | None = None, on_block: Callable[[DataFrame], None] | None = None, extra: tuple[Rule, ...] = ()):
    """call() unless the policy blocks one of the conversations.

    on_inspect gets all decisions, on_block those that block, if any; both as DataFrames."""
    found = decisions(messages, policy, extra=extra).persist()
    try:
        hit = found.where("blocked").orderBy("conv_id").limit(1).collect()
        if on_inspect is not None:
            on_inspect(found)
        if hit and on_block is not None:
            on_block(found.where("blocked"))
    finally:
        found.unpersist()
    if hit:
        raise Blocked(hit[0]["conv_id"], hit[0]["score"])
    return call()


def guard_stream(messages: DataFrame, on_batch: Callable[[DataFrame, int], None], checkpoint: str, policy: Policy | None = None, once: bool = False, extra: tuple[Rule, ...] = ()):
    """A query over streamed messages; each batch's findings go to on_batch with the batch number."""

    def run(batch: DataFrame, number: int) -> None:
        on_batch(inspect(batch, policy, extra=extra), number)

    writer = messages.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def _kept(state) -> list:
    return json.loads(state.get[0]) if state.exists else []


def decisions_stream(messages: DataFrame, policy: Policy | None = None, hint: str = "ts", extra: tuple[Rule, ...] = (), idle_ms: int = 3_600_000) -> DataFrame:
    """Decisions on streamed messages (conv_id, idx, role, text): a batch gives one for each conversation that it brings something of.

    Whatever the batching, a conversation's last decision is that of decisions() on all its messages so far: the state of a
    conversation is its findings. One without messages for idle_ms is told once more with expired, and forgotten.
    Written in update mode; a stream's state is kept in its checkpoint. For a run over what is there (availableNow), set
    spark.sql.streaming.noDataMicroBatches.enabled to false, as Spark else waits for timeouts without end."""
    chosen = policy or Policy()
    rules, stops, limit = chosen.rules(extra), [s for s, a in chosen.actions.items() if a == "block"], chosen.block_threshold
    found = with_points(raw_matches(message_prompts(messages, hint, every=True), rules, ("conv_id", "idx", "role"), every=True), rules)
    found = found.select("conv_id", "idx", "role", "rule_id", "line_start", "prompt_ord", "evidence", "risk_points", "severity")
    key = messages.schema["conv_id"].dataType.simpleString()

    def told(conversation, known: list, expired: bool) -> pd.DataFrame:
        score = min(100, sum(x[6] for x in known))
        blocked = (limit is not None and score >= limit) or any(x[7] in stops for x in known)
        return pd.DataFrame({"conv_id": [conversation], "n_findings": [len(known)], "score": [score], "score_label": [label_of(score)], "blocked": [blocked], "expired": [expired]})

    def judge(group, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        known = _kept(state)
        if state.hasTimedOut:
            state.remove()
            yield told(group[0], known, True)
            return
        # of duplicates the first prompt's finding counts, as in a batch
        best = {tuple(x[:4]): x for x in known}
        for part in parts:
            for x in part.loc[part["rule_id"].notna(), ["idx", "role", "rule_id", "line_start", "prompt_ord", "evidence", "risk_points", "severity"]].to_dict("split")["data"]:
                x = [v.item() if hasattr(v, "item") else v for v in x]
                place = tuple(x[:4])
                if place not in best or x[4:6] < best[place][4:6]:
                    best[place] = [*x[:3], int(x[3]), int(x[4]), x[5], int(x[6]), x[7]]
        known = list(best.values())
        state.update((json.dumps(known),))
        state.setTimeoutDuration(idle_ms)
        yield told(group[0], known, False)

    shape = f"conv_id {key}, n_findings long, score int, score_label string, blocked boolean, expired boolean"
    return found.groupBy("conv_id").applyInPandasWithState(judge, shape, "known string", "update", "ProcessingTimeTimeout")


def watched(files: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Streamed files (path, content) to what each new version of a path adds and removes: (path, rule_id, line_start, change).

    The state of a path is its last findings, those that no directive silences. A null content says that the file is gone."""
    marked = files.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("marks", marks_of(F.col("content")))
    found = raw_matches(extract_prompts(marked, ("marks",), every=True), rules, every=True, marks="marks")
    shown = F.when(F.col("suppressed_by").isNull(), F.col("rule_id"))
    found = found.select("path", shown.alias("rule_id"), "line_start")

    def compare(group, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = {tuple(x) for x in _kept(state)}
        now = {(r, int(n)) for part in parts for r, n in part.loc[part["rule_id"].notna(), ["rule_id", "line_start"]].itertuples(index=False)}
        if now:
            state.update((json.dumps(sorted(now)),))
        elif state.exists:
            state.remove()
        rows = [(group[0], r, n, "added") for r, n in sorted(now - before)] + [(group[0], r, n, "removed") for r, n in sorted(before - now)]
        yield pd.DataFrame(rows, columns=["path", "rule_id", "line_start", "change"])

    return found.groupBy("path").applyInPandasWithState(compare, "path string, rule_id string, line_start int, change string", "known string", "update", "NoTimeout")


def watch_files(files: DataFrame, rules: tuple[Rule, ...], on_delta: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
    """A query over streamed files (path, content): each batch's changes go to on_delta, with the batch number.

    After a restart a batch that was told but not marked as done is told again under its number, with the same changes."""
    writer = watched(files, rules).writeStream.outputMode("update").foreachBatch(on_delta).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def finding_rate(findings: DataFrame, length: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Number of timed findings (ts, severity) by window and severity; of a stream, rows later than `late` are dropped."""
    found = findings.withWatermark("ts", late)
    return found.groupBy(F.window("ts", length), "severity").agg(F.count("*").alias("n"))
