"""Choice of paragraphs for rewriting, quotas, prompts, a pluggable client, and progress."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import patterns as P
from scriptorium.operators.splitting import ranked


def eligible(paragraphs: DataFrame) -> DataFrame:
    return paragraphs.where((F.col("para_type") == "normal") & ~F.coalesce(F.col("chapter_role"), F.lit("")).isin(*P.EXCLUDED_ROLES))


def unprocessed(paragraphs: DataFrame, existing: DataFrame, legacy: bool = False) -> DataFrame:
    """Paragraphs without a variant yet, by document and index; the legacy comparison of ids of two forms never matched and skips nothing."""
    if legacy:
        return paragraphs
    done = existing.select(F.col("doc_id").alias("id")).distinct()
    key = F.concat_ws("_", F.col("doc_id"), F.col("para_index").cast("string"))
    return paragraphs.withColumn("id", key).join(done, "id", "left_anti").drop("id")


def quota(paragraphs: DataFrame, counts: DataFrame, targets: DataFrame, order: str = "row_id") -> DataFrame:
    """For each target the first rows of its split up to what is missing; the limit of length applies after the cut, so fewer may come out.

    targets: split, variant_type, target; counts: split, variant_type, have. Rows are ranked once a split, not once a target, and no split is sorted as a whole.
    """
    need = targets.join(counts, ["split", "variant_type"], "left").select("split", "variant_type", F.greatest(F.lit(0), F.col("target") - F.coalesce("have", F.lit(0))).alias("need"))
    wanted = need.where("need > 0").select("split").distinct()
    rows = ranked(paragraphs.join(F.broadcast(wanted), "split", "left_semi"), ["split"], order, out="rn")  # one row a split
    out = rows.join(F.broadcast(need), "split").where("rn <= need")  # one row a target
    return out.where(F.length("text").between(50, 2000)).drop("need")


#: Instructions of each kind of rewriting; {text} stands for the paragraph.
TEMPLATES = {
    "hard_human": "轻微润色以下段落，只做最小修改，保留句式和用词：\n{text}\n润色后：",
    "multi_round_rewrite": "对以下段落做两轮改写，先学术化，再加入个人风格：\n{text}\n最终改写后：",
    "partial_rewrite": "只改写以下段落中的两三个关键句，其余不动：\n{text}\n改写后：",
    "back_translation_mix": "把以下段落译成英文再译回中文，并使其通顺：\n{text}\n回译润色后：",
    "polish_manual_mix": "适度润色以下段落，改正明显语病，保留个人写作特征：\n{text}\n润色后：",
    "standard_rewrite": "按学术规范改写以下段落，保持核心意思：\n{text}\n改写后：",
}


def prompt(text: Column, kind: Column) -> Column:
    out = None
    for k, t in TEMPLATES.items():
        c = F.replace(F.lit(t), F.lit("{text}"), text)
        out = F.when(kind == k, c) if out is None else out.when(kind == k, c)
    return out


def temperature(kind: Column) -> Column:
    out = None
    for k, v in P.TEMPERATURE.items():
        out = F.when(kind == k, F.lit(v)) if out is None else out.when(kind == k, F.lit(v))
    return out


Client = Callable[[str, float], tuple[bool, str, int]]


def offline_client(prompt_text: str, temp: float) -> tuple[bool, str, int]:
    """A deterministic answer without any service: the paragraph with a few words exchanged."""
    body = prompt_text.split("\n", 1)[1].rsplit("\n", 1)[0] if prompt_text.count("\n") > 1 else prompt_text
    for a, b in (("研究", "分析"), ("因此", "所以"), ("企业", "公司")):
        body = body.replace(a, b)
    return True, body, 200


def http_client(url: str, model: str, key: str | None = None, timeout: float = 120.0, retries: int = 0) -> Client:
    """A client of a chat-completion service: (True, text, status), or (False, what went wrong, status or 0). The key is sent, never kept in a plan."""

    def call(prompt_text: str, temp: float) -> tuple[bool, str, int]:
        import json
        import urllib.error
        import urllib.request

        body = json.dumps({"model": model, "messages": [{"role": "user", "content": prompt_text}], "temperature": temp}).encode()
        head = {"Content-Type": "application/json", **({"Authorization": f"Bearer {key}"} if key else {})}
        out = (False, "no attempt", 0)
        for _ in range(retries + 1):
            try:
                with urllib.request.urlopen(urllib.request.Request(url, body, head), timeout=timeout) as r:
                    return True, json.loads(r.read())["choices"][0]["message"]["content"].strip(), r.status
            except urllib.error.HTTPError as e:
                out = False, f"HTTP {e.code}", e.code
            except (TimeoutError, OSError, ValueError, KeyError, IndexError) as e:
                out = False, f"{type(e).__name__}: {e}", 0
        return out

    return call


@dataclass
class ErrorPolicy:
    """Three failures in a row send a slot to its fallback for nine minutes."""

    threshold: int = 3
    duration: float = 540.0
    errors: dict[str, int] = field(default_factory=dict)
    until: dict[str, float] = field(default_factory=dict)

    def record(self, provider: str, status: int) -> bool:
        if not 400 <= status < 600:
            if status == 200:
                self.errors[provider] = 0
            return False
        self.errors[provider] = self.errors.get(provider, 0) + 1
        return self.errors[provider] >= self.threshold

    def activate(self, slot: str, now: float | None = None) -> None:
        self.until[slot] = (time.time() if now is None else now) + self.duration

    def active(self, slot: str, now: float | None = None) -> bool:
        return self.until.get(slot, 0.0) > (time.time() if now is None else now)


def slot_provider(slot: int, providers: tuple[str, ...], started: float, now: float, interval: float = 900.0) -> str:
    """Providers change places round robin every interval."""
    return providers[(slot + int((now - started) // interval)) % len(providers)]


ANSWER = "answer string, ok boolean, status int, provider string, error string"


def generate(jobs: DataFrame, client: Client = offline_client, fallback: Client | None = None, providers: dict[str, Client] | None = None, slot_col: str | None = None, interval: float = 900.0) -> DataFrame:
    """The jobs (prompt, temperature) with answer, ok, status, provider and error, by clients called in the workers.

    Each worker keeps the errors of its providers: a slot whose provider failed three times in a row goes to the fallback for nine minutes; every
    failed call is tried once with the fallback. With several `providers`, slots (values of slot_col) change theirs round robin every interval.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    jobs = jobs.drop("answer", "ok", "status", "provider", "error")
    out = StructType([*jobs.schema.fields, *_parse_datatype_string(ANSWER).fields])
    calls = dict(providers or {"main": client})
    names = tuple(calls)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        policy, began = ErrorPolicy(), time.time()
        slots: dict[str, int] = {}
        for pdf in it:
            rows = []
            for s, p, t in zip(pdf[slot_col] if slot_col else ["main"] * len(pdf), pdf["prompt"], pdf["temperature"]):
                slot = str(s)
                name = slot_provider(slots.setdefault(slot, len(slots)), names, began, time.time(), interval)
                if fallback is not None and policy.active(slot):
                    ok, text, status = fallback(p, t)
                    name = "fallback"
                else:
                    ok, text, status = calls[name](p, t)
                    if policy.record(name, status) and fallback is not None:
                        policy.activate(slot)
                        policy.errors[name] = 0
                    if not ok and fallback is not None:
                        ok, text, status = fallback(p, t)
                        name = "fallback"
                rows.append((text if ok else None, ok, status, name, None if ok else text))
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pdf.assign(answer=cols[0], ok=cols[1], status=cols[2], provider=cols[3], error=cols[4])

    return jobs.mapInPandas(run, out)


def run_statistics(answers: DataFrame) -> DataFrame:
    """(provider, calls, ok, failed): how a run of `generate` went, by provider."""
    return answers.groupBy("provider").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"))


def fan_out(spark, splits: tuple[str, ...] = ("train", "dev", "test"), kinds: tuple[str, ...] = P.VARIANT_TYPES[:5], target: int = 400) -> DataFrame:
    """Every split with every kind: two lists of a few names."""
    return spark.createDataFrame([(s, k, target) for s in splits for k in kinds], "split string, variant_type string, target int")


def progress(targets: DataFrame, variants: DataFrame) -> DataFrame:
    """(split, variant_type, current, target, percentage): capped at 100."""
    have = variants.groupBy("split", "variant_type").agg(F.count("*").alias("current"))
    d = targets.join(have, ["split", "variant_type"], "left").withColumn("current", F.coalesce("current", F.lit(0)))
    pct = F.when(F.col("current") >= F.col("target"), F.lit(100.0)).when(F.col("target") > 0, F.col("current") * 100.0 / F.col("target")).otherwise(F.lit(0.0))
    return d.select("split", "variant_type", "current", "target", F.round(pct, 6).alias("percentage"))


def overall(progress_rows: DataFrame, elapsed: float) -> DataFrame:
    """One row: totals of all targets, minutes gone and minutes left at the pace so far."""
    g = progress_rows.agg(F.coalesce(F.sum("current"), F.lit(0)).alias("total_current"), F.coalesce(F.sum("target"), F.lit(0)).alias("total_target"))
    pct = F.when(F.col("total_target") > 0, F.col("total_current") * 100.0 / F.col("total_target")).otherwise(F.lit(0.0))
    left = F.when((F.col("total_current") > 0) & (pct < 100), F.lit(float(elapsed)) / (pct / 100.0) - F.lit(float(elapsed))).otherwise(F.lit(0.0))
    return g.select("total_current", "total_target", F.round(pct, 6).alias("total_percentage"), F.lit(int(elapsed // 60)).alias("elapsed_minutes"), F.floor(left / 60).cast("int").alias("remaining_minutes"))


def notify(progress_rows: DataFrame, elapsed: float, send: Callable[[str, str], None] | None) -> bool:
    """A message on the progress of a run through a hook that takes title and text; without a hook nothing is sent. The targets are a fixed list."""
    if send is None:
        return False
    t = overall(progress_rows, elapsed).first()
    lines = [f"{t['elapsed_minutes']} min, {t['total_current']}/{t['total_target']} ({t['total_percentage']:.1f}%), {t['remaining_minutes']} min left"]
    lines += [f"- {r['split']}/{r['variant_type']}: {r['current']}/{r['target']} ({'done' if r['percentage'] >= 100 else format(r['percentage'], '.0f') + '%'})" for r in progress_rows.orderBy("split", "variant_type").collect()]
    try:
        send(f"{t['total_percentage']:.0f}%, {t['elapsed_minutes']} min", "\n".join(lines))
    except Exception:  # a message that can't be sent never ends a run
        return False
    return True
