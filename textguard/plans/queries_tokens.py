"""Tokens, their lifetimes, restoring, and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from textguard.functions.keyed import with_key
from textguard.operators.tokens import apply_tokens, collisions, number_values, occurrences, placeholder, restore, scoped_tag, vault
from textguard.operators.vault import idle_epochs, life_ends, micros, vault_accesses, with_idle_epoch
from textguard.plans.catalog import (
    DEMO_KEY,
    DOCUMENTS_SQL,
    SEEDED_SQL,
    SEEDED_TEXT,
    framed_sql,
    hmac_sql,
    mask_policy,
    query,
    redacted_ctes,
    regex_policy,
    resolved_ctes,
    seeded_turns,
    table,
    token_sql,
)
from textguard.plans.redact import inspect_texts, redact_texts, redact_with_lives
from textguard.session import durable, scratch_folder
from textguard.streaming.requests import redact_text_stream, redacted_requests
from textguard.streaming.vault import life_stream

_FULL = regex_policy(secrets=True, rules=True)
_TTL = 24 * 3600
_CAP = 100

_MINTED_CTE = """
  minted AS (SELECT k.id, k.start, k.category, k.value, k.rule_id, CAST(k.id // 1000 AS VARCHAR) AS conversation
             FROM kept AS k WHERE action = 'tokenize' AND id NOT IN (SELECT id FROM kept WHERE action = 'block'))"""
_MINTED = f"{resolved_ctes(SEEDED_SQL, _FULL)}, {_MINTED_CTE}"
_LABEL = "CASE rule_id WHEN 'client_codename' THEN 'CODENAME' WHEN 'internal_ticket' THEN 'TICKET' ELSE upper(category) END"
_NUMBERED = f"""numbered AS (
  SELECT category, value, '[' || {_LABEL} || '_' || printf('%03d', CAST(row_number() OVER (PARTITION BY category ORDER BY id, start) AS INTEGER)) || ']' AS token
  FROM (SELECT DISTINCT ON (category, value) * FROM minted ORDER BY category, value, id, start) AS f)"""


def _minted(spark, folder):
    items = inspect_texts(seeded_turns(spark, folder), _FULL)
    return items, occurrences(items, _FULL, ["conv_id", "turn"], ["id"])


@query("tokens_sequential", f"WITH RECURSIVE {_MINTED}, {_NUMBERED} SELECT category, value, token FROM numbered")
def tokens_sequential(spark, folder):
    _, found = _minted(spark, folder)
    return number_values(found, ["conv_id", "turn"]).drop("n_found")


_NUMBER_OF = "(SELECT token FROM numbered AS n WHERE n.category = k.category AND n.value = k.value)"
_APPLIED = redacted_ctes(SEEDED_SQL, _FULL, token=_NUMBER_OF, token_ctes=f"{_MINTED_CTE}, {_NUMBERED},")


@query("tokens_sequential_applied", f"WITH RECURSIVE {_APPLIED} SELECT id, redacted FROM redacted")
def tokens_sequential_applied(spark, folder):
    items, found = _minted(spark, folder)
    items, found = durable(items), durable(found)
    done = apply_tokens(items, found, number_values(found, ["conv_id", "turn"]), _FULL, ["id"])
    return done.select("id", "redacted")


def _ledger(spark, folder):
    _, found = _minted(spark, folder)
    return vault(found.withColumn("conversation", F.col("conv_id").cast("string")), DEMO_KEY, "conversation")


@query(
    "tokens_scoped",
    f"""WITH RECURSIVE {_MINTED} SELECT DISTINCT conversation, CAST(0 AS BIGINT) AS epoch,
          {token_sql('conversation', _FULL)} AS token, category, value FROM minted""",
)
def tokens_scoped(spark, folder):
    return _ledger(spark, folder)


@query(
    "token_collision_check",
    f"""WITH RECURSIVE {_MINTED} SELECT conversation, {token_sql('conversation', _FULL)} AS token,
          count(DISTINCT category || value) AS n_values FROM minted GROUP BY ALL HAVING count(DISTINCT category || value) > 1""",
)
def token_collision_check(spark, folder):
    return collisions(_ledger(spark, folder))


_SHORT_TOKEN_SQL = f"regexp_replace({token_sql('conversation', _FULL)}, '[0-9a-f]{{15}}\\]$', ']')"


@query(
    "token_collisions_planted",
    f"""WITH RECURSIVE {_MINTED} SELECT conversation, {_SHORT_TOKEN_SQL} AS token, count(DISTINCT category || value) AS n_values
        FROM minted GROUP BY ALL HAVING count(DISTINCT category || value) > 1""",
)
def token_collisions_planted(spark, folder):
    """The collision check on tokens cut to one digit, which do collide."""
    short = F.regexp_replace("token", r"[0-9a-f]{15}\]$", "]")
    return collisions(_ledger(spark, folder).withColumn("token", short))


@query(
    "restore_tokens",
    f"WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL, token='value')} SELECT id, redacted AS restored FROM redacted WHERE allowed",
)
def restore_tokens(spark, folder):
    """Redact, then restore within each conversation: only masks remain."""
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("conv_id").cast("string"), DEMO_KEY)
    texts = done.where("allowed").select(
        "id", F.col("conv_id").cast("string").alias("conversation"), F.col("redacted").alias("text")
    )
    return restore(durable(texts), durable(_ledger(spark, folder)), "id").select("id", "restored")


@query(
    "restore_other_conversation",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL, "CAST(conv_id AS VARCHAR)")}
        SELECT id, redacted AS restored FROM redacted WHERE allowed""",
)
def restore_other_conversation(spark, folder):
    """Tokens asked for under another conversation stay as they are."""
    done = redact_texts(seeded_turns(spark, folder), _FULL, F.col("conv_id").cast("string"), DEMO_KEY)
    texts = done.where("allowed").select(
        "id", F.concat(F.lit("x"), F.col("conv_id").cast("string")).alias("conversation"), F.col("redacted").alias("text")
    )
    return restore(durable(texts), durable(_ledger(spark, folder)), "id").select("id", "restored")


_EPOCHS_SQL = f"""SELECT user_id, event_id, CAST(sum(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
  FROM (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) > {_TTL}000000 THEN 1 ELSE 0 END AS ended
        FROM events) AS g"""


def _events(spark, folder):
    return table(spark, folder, "events").select("user_id", "ts", "event_id")


@query("token_epochs_ttl", _EPOCHS_SQL)
def token_epochs_ttl(spark, folder):
    return with_idle_epoch(_events(spark, folder), "user_id", "ts", _TTL).select("user_id", "event_id", "epoch")


@query("token_epoch_counts", f"SELECT user_id, max(epoch) + 1 AS n_lives FROM ({_EPOCHS_SQL}) AS e GROUP BY user_id")
def token_epoch_counts(spark, folder):
    epochs = idle_epochs(_events(spark, folder), "user_id", "ts", _TTL)
    return epochs.groupBy("user_id").agg((F.max("epoch") + 1).alias("n_lives"))


_LRU_SQL = f"""WITH a AS (SELECT user_id, event_id, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM events),
  p AS (SELECT *, lag(rn) OVER w AS prev, lag(t) OVER w AS prev_t FROM a WINDOW w AS (PARTITION BY user_id ORDER BY rn)),
  d AS (SELECT i.user_id, i.event_id, i.rn, any_value(i.prev) AS prev, any_value(i.t - i.prev_t) AS gap,
               count(j.rn) FILTER (j.prev IS NULL OR j.prev < i.prev) AS others
        FROM p AS i LEFT JOIN p AS j ON j.rn > i.prev AND j.rn < i.rn GROUP BY i.user_id, i.event_id, i.rn),
  h AS (SELECT *, prev IS NOT NULL AND gap <= {_TTL}000000 AND others < {_CAP} AS hit FROM d)
  SELECT user_id, event_id, hit, CAST(count(*) FILTER (NOT hit) OVER (PARTITION BY user_id ORDER BY rn) - 1 AS BIGINT) AS epoch FROM h"""


@query("lru_misses", _LRU_SQL)
def lru_misses(spark, folder):
    done = vault_accesses(_events(spark, folder), "user_id", "ts", "event_id", _TTL, _CAP)
    return done.select("user_id", "event_id", "hit", "epoch")


_LIFE_MESSAGE = framed_sql("CAST(user_id AS VARCHAR)", "CAST(epoch AS VARCHAR)", "'account_number'", "'same value'")


@query(
    "tokens_scoped_by_life",
    f"""SELECT user_id, event_id, '[ACCOUNT_NUMBER_' || left({hmac_sql(_LIFE_MESSAGE)}, 16) || ']' AS token
        FROM ({_EPOCHS_SQL}) AS e""",
)
def tokens_scoped_by_life(spark, folder):
    """One value per user: its token changes when the user's mapping has expired."""
    lives = with_key(with_idle_epoch(_events(spark, folder), "user_id", "ts", _TTL), DEMO_KEY)
    tag = scoped_tag(
        F.col("user_id").cast("string"), F.col("epoch"), F.lit("account_number"), F.lit("same value")
    )
    return lives.select("user_id", "event_id", placeholder(F.lit("ACCOUNT_NUMBER"), tag).alias("token"))


# Events as timed texts: each names its user's address.
_TIMED_TEXT = "'mail user' || CAST(user_id % 97 AS STRING) || '@example.com'"
_MAIL_MESSAGE = framed_sql(
    "CAST(user_id AS VARCHAR)", "CAST(epoch AS VARCHAR)", "'private_email'", "'user' || CAST(user_id % 97 AS VARCHAR) || '@example.com'"
)
_LIVES_SQL = f"""SELECT user_id, event_id, ts, epoch, 'mail [PRIVATE_EMAIL_' || left({hmac_sql(_MAIL_MESSAGE)}, 16) || ']' AS redacted
  FROM ({_EPOCHS_SQL}) AS e JOIN (SELECT event_id, ts FROM events) AS t USING (event_id)"""


def _lives(spark, folder):
    texts = table(spark, folder, "events").selectExpr("user_id", "ts", "event_id", f"{_TIMED_TEXT} AS text")
    policy = regex_policy()
    policy.tokenization.ttl_seconds = _TTL
    return redact_with_lives(texts, policy, "user_id", "ts", DEMO_KEY)


@query("redact_with_lives", f"SELECT event_id, epoch, redacted FROM ({_LIVES_SQL}) AS l")
def redact_lives(spark, folder):
    """Timed texts; the policy's time-out decides when a user's tokens change."""
    return _lives(spark, folder).select("event_id", "epoch", "redacted")


@query(
    "restore_expired",
    f"""SELECT event_id, CASE WHEN ts + INTERVAL 1 SECOND * ({_TTL} * (event_id % 4)) <= last + INTERVAL {_TTL} SECOND
               THEN 'mail user' || CAST(user_id % 97 AS VARCHAR) || '@example.com' ELSE redacted END AS restored
        FROM (SELECT *, max(ts) OVER (PARTITION BY user_id, epoch) AS last FROM ({_LIVES_SQL}) AS l) AS w""",
)
def restore_expired(spark, folder):
    """Restoring up to three time-outs later: only within the life of a token."""
    done = durable(_lives(spark, folder).select("user_id", "event_id", "ts", "epoch", "text", "redacted"))
    ends = life_ends(done, "user_id", "ts", _TTL)
    # Two columns of one row: here every text is one token.
    ledger = done.select(
        "user_id", "epoch", F.expr("substr(redacted, 6)").alias("token"), F.expr("substr(text, 6)").alias("value")
    ).distinct()
    timed = ledger.join(ends, ["user_id", "epoch"]).withColumn("conversation", F.col("user_id").cast("string"))
    asked = done.select(
        "event_id",
        F.col("user_id").cast("string").alias("conversation"),
        F.expr(f"ts + make_dt_interval(0, 0, 0, {_TTL} * (event_id % 4))").alias("at"),
        F.col("redacted").alias("text"),
    )
    return restore(durable(asked), durable(timed), "event_id", at="at").select("event_id", "restored")


# -- streams ------------------------------------------------------------------------------------


def _stream(spark, folder, name):
    """A table as a stream, be it one file, or a folder of files or of folders of them."""
    file = f"{name}.parquet"
    rows = table(spark, folder, name)
    source = spark.readStream.schema(rows.schema)
    if any(f"/{file}/" in path for path in rows.inputFiles()):
        return source.parquet(f"{folder}/{file}")
    return source.option("pathGlobFilter", file).parquet(folder)


def _read_sink(spark, path, written):
    """What a stream has written; nothing, if no batch had rows."""
    return spark.read.schema(written.schema).parquet(path)


_MASK = mask_policy(secrets=True)


@query(
    "stream_redact",
    f"WITH RECURSIVE {redacted_ctes(DOCUMENTS_SQL, _MASK)} SELECT id, redacted, n_findings FROM redacted",
)
def stream_redact(spark, folder):
    """Documents as a stream, redacted row by row in append mode."""
    out = scratch_folder(spark, "stream-redact")
    texts = _stream(spark, folder, "documents").select(F.col("doc_id").alias("id"), "text")
    # One file per batch here: without this, one task would do all the work.
    texts = texts.repartition(4 * spark.sparkContext.defaultParallelism, "id")
    done = redact_text_stream(texts, _MASK, F.col("id").cast("string"), DEMO_KEY)
    done = done.select("id", "redacted", F.size("resolved").cast("bigint").alias("n_findings"))
    run = done.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
    run.start(f"{out}/rows", format="parquet").awaitTermination()
    return _read_sink(spark, f"{out}/rows", done)


@query(
    "stream_requests",
    f"""WITH RECURSIVE {redacted_ctes(SEEDED_SQL, _FULL)}
        SELECT id AS request_id, CASE WHEN allowed THEN 'allowed' ELSE 'quarantine' END AS sink FROM redacted""",
)
def stream_requests(spark, folder):
    """Requests as a stream, in append mode, into one table split into allowed and quarantined."""
    out = scratch_folder(spark, "stream-requests")
    turns = _stream(spark, folder, "conversations").selectExpr("conv_id * 1000 + turn AS id", "role", f"{SEEDED_TEXT} AS text")
    payload = F.to_json(F.struct(F.array(F.struct("role", F.col("text").alias("content"))).alias("messages")))
    requests = turns.select(F.col("id").alias("request_id"), payload.alias("payload"))
    # One file per batch here: without this, one task would do all the work.
    requests = requests.repartition(4 * spark.sparkContext.defaultParallelism, "request_id")
    done = redacted_requests(requests, _FULL, DEMO_KEY).select("request_id", "redacted_payload", "n_findings", "sink")
    run = done.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).partitionBy("sink")
    run.start(f"{out}/rows", format="parquet").awaitTermination()
    return _read_sink(spark, f"{out}/rows", done).select("request_id", "sink")


def _rocksdb(spark):
    """Set the state store that keyed timers need; returns what undoes it."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return lambda: spark.conf.set(setting, before)


_BATCHES = 4
_DELAY_HOURS = 6
# Each event arrives up to five hours late; batches cut the range of arrivals evenly. One in 97 may arrive after all others.
_LATE = "event_id % 97 = 0"
_LIVES_STREAM_SQL = f"""WITH e AS (SELECT * FROM events WHERE NOT ({_LATE})),
  g AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > {_TTL}000000 THEN 1 ELSE 0 END AS ended
        FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  l AS (SELECT *, sum(ended) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM g)
  SELECT user_id, event_id, min(epoch_us(ts)) OVER (PARTITION BY user_id, n) AS life, false AS late FROM l
  UNION ALL SELECT user_id, event_id, NULL, true FROM events WHERE {_LATE}"""


def _lives_of_events(spark, folder, late: bool):
    """Events in order of arrival, landed batch by batch, each batch shuffled and read in a run of its own on one checkpoint; then a row
    of a much later time, which moves the watermark past everything; then, if wanted, the late ones."""
    out = scratch_folder(spark, "stream-lives")
    events = table(spark, folder, "events").select("user_id", "ts", "event_id")
    timed = durable(events.withColumn("arrival", micros(events, "ts") + (F.col("event_id") * 7919 % 18000) * 1_000_000))
    first, last = timed.agg(F.min("arrival"), F.max("arrival")).first()
    batch = F.floor((F.col("arrival") - first) / ((last - first) // _BATCHES + 1))
    timed = timed.withColumn("batch", F.when(F.expr(_LATE) if late else F.lit(False), -1).otherwise(batch))
    spread = spark.sparkContext.defaultParallelism
    much_later = timed.agg((F.max("ts") + F.expr("INTERVAL '400' DAY")).alias("ts"))
    beat = much_later.select(F.lit(-1).cast("bigint").alias("user_id"), "ts", F.lit(None).cast("bigint").alias("event_id"))
    parts = [timed.where(F.col("batch") == k).select(events.columns).repartition(spread) for k in range(_BATCHES)] + [beat]
    if late:
        parts.append(timed.where("batch = -1").select(events.columns))
    undo = _rocksdb(spark)
    try:
        for part in parts:
            part.write.mode("append").parquet(f"{out}/landed")
            source = spark.readStream.schema(events.schema).parquet(f"{out}/landed")
            lives = life_stream(source, "user_id", "ts", _TTL, f"{_DELAY_HOURS} hours", ("event_id",))
            run = lives.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True)
            run.start(f"{out}/rows", format="parquet").awaitTermination()
    finally:
        undo()
    rows = spark.read.parquet(f"{out}/rows").where("event_id IS NOT NULL")
    return rows.select(F.col("conversation").cast("bigint").alias("user_id"), "event_id", "life", "late")


@query("stream_lives", _LIVES_STREAM_SQL)
def stream_lives(spark, folder):
    """Lives of conversations in event time, from events that arrive out of order, and some too late."""
    return _lives_of_events(spark, folder, late=True)


@query("stream_epochs", _EPOCHS_SQL)
def stream_epochs(spark, folder):
    """The same lives, numbered per conversation."""
    by_start = Window.partitionBy("user_id").orderBy("life")
    epoch = (F.dense_rank().over(by_start) - 1).cast("bigint").alias("epoch")
    return _lives_of_events(spark, folder, late=False).select("user_id", "event_id", epoch)
