"""From step results to one verdict, one action and one answer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from artisieve.sources.staging import staged

STEPS = "style attachments binary userdb tor rbl uribl banlist badwords rate_limit custom headers".split()
EXEMPT = [48, 95]


def combine(articles: DataFrame, results: dict[str, DataFrame | Column]) -> DataFrame:
    """Adds ``results``: one struct (step, legacy_code) for each step in order; a step without a row passed. A step is a table
    with at most one row an article, (article_id, legacy_code), or an expression over ``articles``, which costs no join."""
    out, codes = articles, {}
    for name, step in results.items():
        codes[name] = step if isinstance(step, Column) else F.col(f"__{name}")
        if isinstance(step, DataFrame):
            out = out.join(step.select("article_id", F.col("legacy_code").alias(f"__{name}")), "article_id", "left")
    entries = [F.struct(F.lit(n).alias("step"), F.coalesce(c, F.lit(0)).alias("legacy_code")) for n, c in codes.items()]
    return out.withColumn("results", F.array(*entries)).drop(*[f"__{n}" for n in results])


def first_failure(results: Column, bypass: Column | None = None) -> Column:
    """The first failing step's struct, null where all pass or a profile bypasses them."""
    failed = F.get(F.filter(results, lambda r: r["legacy_code"] != 0), F.lit(0))
    return failed if bypass is None else F.when(~bypass, failed)


def enforce(articles: DataFrame, steps: list[tuple[str, Callable[[DataFrame], DataFrame] | Column]]) -> DataFrame:
    """(article_id, step, legacy_code) of rejected articles. Each step runs over the articles that are still open: a table from
    their ids, or an expression over ``articles``. Expressions that follow each other share one scan, whose codes are staged
    for all articles, since a filter on them would compute them once more."""
    open_, found = None, []
    for plain, run in groupby(steps, lambda s: isinstance(s[1], Column)):
        if plain:
            source = articles if open_ is None else articles.join(open_, "article_id", "left_semi")
            first = first_failure(F.array(*(F.struct(F.lit(n).alias("step"), F.coalesce(c, F.lit(0)).alias("legacy_code")) for n, c in run)))
            codes = staged(source.select("article_id", first.alias("f")), "enforce-codes")
            found.append(codes.where("f IS NOT NULL").select("article_id", "f.step", "f.legacy_code"))
            open_ = codes.where("f IS NULL").select("article_id")
            continue
        for name, step in run:
            open_ = articles.select("article_id") if open_ is None else open_
            bad = staged(step(open_).where("legacy_code <> 0").select("article_id", F.lit(name).alias("step"), "legacy_code"), f"enforce-{name}")
            found.append(bad)
            open_ = open_.join(bad.select("article_id"), "article_id", "left_anti")
    return reduce(DataFrame.unionByName, found)


def server_mode(mode: str, code: Column) -> Column:
    """``closed`` rejects all with 48; ``disabled`` passes all."""
    return F.lit(48) if mode == "closed" else F.lit(0) if mode == "disabled" else code


def resolve(code: Column, audit: Column, requested: Column | None = None, on_reject: str = "reject", on_accept: str = "accept", force_save: Column | None = None, save_rejected: Column | None = None) -> Column:
    """Struct (action, audit_mode, nntp_result, save, would_reject, legacy_code).

    In audit mode a rejection is accepted and marked, save for codes 48 and 95. Otherwise the requested action, else the
    configured one (an unknown one rejects), decides. A pass with a rejecting default becomes 47.
    """
    actions = ["accept", "save", "discard", "reject"]
    requested = requested if requested is not None else F.lit(None).cast("string")
    wish = F.when(code != 0, F.coalesce(requested, F.lit(on_reject))).otherwise(F.coalesce(requested, F.lit(on_accept)))
    action = F.when(wish.isin(*actions), wish).otherwise("reject")
    rejected = code != 0
    quiet = audit & rejected & ~code.isin(*EXEMPT)
    result = F.when(quiet, "accepted").when(action == "accept", "accepted").when((action == "save") & ~rejected, "accepted").when(action == "discard", "discarded").otherwise("rejected")
    final_code = F.when(~rejected & (action == "reject"), 47).otherwise(code)
    wanted = F.coalesce(save_rejected, F.lit(False)) if save_rejected is not None else F.lit(False)
    forced = F.coalesce(force_save, F.lit(False)) if force_save is not None else F.lit(False)
    save = forced | (action == "save") | (rejected & wanted)
    return F.struct(action.alias("action"), audit.alias("audit_mode"), result.alias("nntp_result"), save.alias("save"), quiet.alias("would_reject"), final_code.alias("legacy_code"))


def should_save(code: Column, symbol: Column, rule_id: Column, mode: str = "all", selected: list[str] | None = None) -> Column:
    """Whether a rejection is saved: ``all``, ``none``, or ``selected`` by number, symbol or rule."""
    if mode in ("all", "none"):
        return F.lit(mode == "all")
    s = selected or []
    return F.coalesce(code.cast("string").isin(s), F.lit(False)) | F.coalesce(symbol.isin(s), F.lit(False)) | F.coalesce(rule_id.isin(s), F.lit(False))


def response(final: Column, message: Column) -> Column:
    """'' for an accepted article, DROP for a discarded one, else the message or a general text."""
    return F.when(final["nntp_result"] == "accepted", "").when(final["nntp_result"] == "discarded", "DROP").otherwise(F.coalesce(F.nullif(message, F.lit("")), F.lit("Article rejected")))


def explain(combined: DataFrame, server: str | None = None) -> DataFrame:
    """(article_id, step_no, step, legacy_code, verdict): one row for each step. With ``server``, the column of what the server
    itself answers once all steps are done, that is the last step, ``inn``."""
    steps = F.col("results") if server is None else F.concat("results", F.array(F.struct(F.lit("inn").alias("step"), F.coalesce(F.col(server), F.lit(0)).alias("legacy_code"))))
    return combined.select("article_id", F.posexplode(steps).alias("step_no", "r")).select("article_id", "step_no", "r.step", "r.legacy_code", F.when(F.col("r.legacy_code") == 0, "pass").otherwise("reject").alias("verdict"))


def custom_rule(articles: DataFrame, rule: Callable, columns: list[str], on_error: str = "accept") -> DataFrame:
    """(article_id, legacy_code, message) from a user's ``rule(dict) -> None | '' | 0 | code | text``, in Arrow batches.

    None, '' and 0 pass; digits are a code; other text rejects with 63 and that text. A rule that is missing or fails
    passes, or rejects with 63 where ``on_error`` is ``reject``.
    """
    import pandas as pd

    def one(row: dict) -> tuple[int, str | None]:
        try:
            got = rule(row)
        except Exception as e:  # the error policy decides for a failing user rule
            return (63, str(e)) if on_error == "reject" else (0, None)
        if got in (None, "", 0, "0"):
            return 0, None
        return (int(got), None) if str(got).isdigit() else (63, str(got))

    def run(pages):
        for page in pages:
            out = [one(r) for r in page[columns].to_dict("records")]
            yield pd.DataFrame({"article_id": page["article_id"], "legacy_code": [c for c, _ in out], "message": [m for _, m in out]})

    return articles.select("article_id", *[c for c in columns if c != "article_id"]).mapInPandas(run, "article_id long, legacy_code int, message string")
