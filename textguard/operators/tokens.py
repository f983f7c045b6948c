"""Placeholders for tokenized values, and putting values back."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textguard.functions.keyed import framed, hmac_sha256, with_key
from textguard.functions.regex import match_spans
from textguard.functions.skew import lookup_join, number_within
from textguard.operators.act import splice
from textguard.policy import Policy
from textguard.session import durable

KEY_CONF = "textguard.token.key"
TOKEN_HEX = 16
SCOPED_TOKEN = r"\[[^\[\]]*_[0-9a-f]{16}\]"
ANY_TOKEN = r"\[[A-Z0-9_.:-]+_(?:[0-9a-f]{16}|[0-9]{3,})\]"


def token_key(spark: SparkSession) -> str:
    """The job's secret. Without one, tokens are random per run: safe, but not stable across runs."""
    return spark.conf.get(KEY_CONF, None) or secrets.token_hex(32)


def placeholder(label: Column, tag: Column) -> Column:
    return F.concat(F.lit("["), label, F.lit("_"), tag, F.lit("]"))


def scoped_tag(conversation: Column, epoch: Column, category: Column, value: Column) -> Column:
    """16 hex digits: the same for the same value within one life of a conversation, unrelated
    elsewhere, and not computable without the key. Needs no shared state, hence no shuffle.

    For rows with the ``_key`` column of ``with_key``."""
    message = framed(conversation, epoch.cast("string"), category, value)
    return F.substring(hmac_sha256(F.col("_key"), message), 1, TOKEN_HEX)


def scoped_token(
    policy: Policy, conversation: Column, epoch: Column | None = None
) -> Callable[[Column], Column]:
    """Finding -> placeholder, for rows with the ``_key`` column of ``with_key``."""
    life = F.lit(0) if epoch is None else epoch

    def build(f: Column) -> Column:
        label = policy.token_label_column(f["category"], f["rule_id"])
        return placeholder(label, scoped_tag(conversation, life, f["category"], f["value"]))

    return build


def occurrences(items: DataFrame, policy: Policy, order: list[str], keep: list[str]) -> DataFrame:
    """One row per resolved finding that gets a token: blocked texts mint none."""
    tokenized = F.filter(
        F.col("resolved"),
        lambda f: (policy.action_column(f["category"]) == "tokenize") & ~policy.audit_only_column(f["rule_id"]),
    )
    return (
        items.where("allowed")
        .select(*dict.fromkeys(order + keep), F.explode(tokenized).alias("f"))
        .select(
            *dict.fromkeys(order + keep),
            F.col("f.start").alias("start"),
            F.col("f.end").alias("end"),
            F.col("f.category").alias("category"),
            F.col("f.value").alias("value"),
            policy.token_label_column(F.col("f.category"), F.col("f.rule_id")).alias("label"),
        )
    )


def number_values(found: DataFrame, order: list[str]) -> DataFrame:
    """``(category, value, token, n_found)``: values of a category numbered by first appearance, with the
    label of that first appearance. Copies collapse before the shuffle."""
    firsts = found.groupBy("category", "value").agg(
        F.min(F.struct(*order, "start", "label")).alias("first"), F.count(F.lit(1)).alias("n_found")
    )
    numbered = number_within(
        firsts.select(
            "category", "value", "n_found", *[F.col(f"first.{c}").alias(c) for c in [*order, "start", "label"]]
        ),
        ["category"],
        [*order, "start"],
        "n",
    )
    tag = F.format_string("%03d", F.col("n"))
    return numbered.select("category", "value", placeholder(F.col("label"), tag).alias("token"), "n_found")


def apply_tokens(items: DataFrame, found: DataFrame, tokens: DataFrame, policy: Policy, keys: list[str]) -> DataFrame:
    """Rewrite texts with tokens from a table (sequential mode). ``keys`` identify a text."""
    placed = lookup_join(
        found.select(*keys, "start", "category", "value"), tokens, ["category", "value"], count="n_found"
    )
    per_item = placed.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("start", "token"))).alias("_tokens")
    )
    from textguard.operators.act import replacement_column

    joined = items.join(per_item, keys, "left")
    token = lambda f: F.col("_tokens")[f["start"]]
    spliced = splice(F.coalesce("text", F.lit("")), F.col("resolved"), replacement_column(policy, token))
    return joined.withColumn("redacted", F.when(F.col("allowed"), spliced)).drop("_tokens")


def vault(found: DataFrame, key: str, conversation: str, epoch: Column | None = None) -> DataFrame:
    """Restricted ledger ``(conversation, epoch, token, category, value)`` for restoring. It holds
    raw values: keep it out of reports, and write it only where access is controlled."""
    life = (F.lit(0) if epoch is None else epoch).cast("bigint")
    tag = scoped_tag(F.col(conversation), life, F.col("category"), F.col("value"))
    return with_key(found, key).select(
        F.col(conversation).alias("conversation"),
        life.alias("epoch"),
        placeholder(F.col("label"), tag).alias("token"),
        "category",
        "value",
    ).dropDuplicates(["conversation", "epoch", "token"])


def collisions(ledger: DataFrame) -> DataFrame:
    """Tokens that stand for two values within one conversation; must be empty."""
    return (
        ledger.groupBy("conversation", "token")
        .agg(F.countDistinct("category", "value").alias("n_values"))
        .where("n_values > 1")
    )


def restore(
    texts: DataFrame,
    ledger: DataFrame,
    key: str,
    conversation: str = "conversation",
    text: str = "text",
    at: str | None = None,
) -> DataFrame:
    """Put raw values back for tokens of the same conversation; other tokens stay.

    With ``at`` (the time column of the texts) a token is only restored while its life lasts: the ledger then has an
    ``expires_at`` column (see ``vault.life_ends``).

    Only texts that contain a token are shuffled. Adds ``restored``. ``texts`` is read three times
    and ``ledger`` twice: pass stored tables.
    """
    has_token = F.rlike(F.coalesce(F.col(text), F.lit("")), F.lit(SCOPED_TOKEN))
    plain = texts.where(~has_token).withColumn("restored", F.col(text))
    marked = texts.where(has_token)
    wanted = durable(marked.select(
        key,
        *([] if at is None else [F.col(at).alias("_at")]),
        F.col(conversation).alias("conversation"),
        F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(SCOPED_TOKEN), 0))).alias("token"),
    ))
    life = [] if at is None else ["expires_at"]
    known = ledger.select("conversation", "token", "value", *life).dropDuplicates(["conversation", "token"])
    found = lookup_join(wanted, known, ["conversation", "token"]).where("value IS NOT NULL")
    if at is not None:
        found = found.where(F.col("_at") <= F.col("expires_at"))
    per_text = found.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("token", "value"))).alias("_known")
    )
    spans = match_spans(text, SCOPED_TOKEN)
    put_back = splice(
        F.col(text), spans, lambda s: F.coalesce(F.col("_known")[s["value"]], s["value"])
    )
    filled = marked.join(per_text, key, "left").withColumn("restored", put_back).drop("_known")
    return plain.unionByName(filled)
