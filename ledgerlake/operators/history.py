"""Filing records and conversation history: workspaces, lifecycle, sessions, search, feedback.

An absent owner is the shared guest workspace, so owners are compared null-safe throughout. Changes are
appended rows; the state is the latest row per key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.functions.text import strip

# States of a filing.
TERMINAL = ("ready", "failed")
INTERRUPTED = "Interrupted before indexing finished - upload it again."


def owned_by(user: Column | None) -> Column:
    return F.col("user_id").eqNullSafe(user if user is not None else F.lit(None).cast("bigint"))


def workspace_filings(filings: DataFrame, archived: bool = False) -> DataFrame:
    """The filings on one shelf of every workspace; deleted ones are on none."""
    shelf = F.col("archived_at").isNotNull() if archived else F.col("archived_at").isNull()
    return filings.where(F.col("deleted_at").isNull() & shelf)


def workspace_pages(filings: DataFrame, requests: DataFrame, size: int, archived: bool = False) -> DataFrame:
    """Adds place: for each request the `size` filings of its workspace behind its cursor, newest first, larger ids first at one time.

    requests: (user_id, request, after_ts, after_id); no cursor asks for the first page, and a workspace asks with few requests. The absent owner's
    filings go to requests without a user. Nothing is sorted as a whole: each task keeps `size` rows of a request
    before the shuffle, so a workspace that holds most of the filings costs no more than another one.
    """
    asked = requests.select(F.col("user_id").alias("_user"), "request", "after_ts", "after_id")
    behind = F.col("after_ts").isNull() | (F.struct("created_at", "filing_id") < F.struct("after_ts", "after_id"))
    found = workspace_filings(filings, archived).join(asked, F.col("user_id").eqNullSafe(F.col("_user")) & behind)
    newest = Window.partitionBy("user_id", "request").orderBy(F.desc("created_at"), F.desc("filing_id"))
    return found.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= size).drop("_user", "after_ts", "after_id")


def latest_state(changes: DataFrame) -> DataFrame:
    """filings as of now from a change log (filing_id, ts, status, num_pages, custom_title, archived, deleted).

    A null field leaves the earlier value; archived and deleted are true or false when a change sets them.
    """
    def last(name: str) -> Column:
        return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("ts"))).alias(name)

    fields = [c for c in changes.columns if c not in ("filing_id", "ts")]
    return changes.groupBy("filing_id").agg(*[last(c) for c in fields], F.max("ts").alias("updated_at"))


def fail_interrupted(filings: DataFrame) -> DataFrame:
    stuck = ~F.col("status").isin(*TERMINAL)
    return filings.withColumn("error", F.when(stuck, INTERRUPTED).otherwise(F.col("error"))).withColumn(
        "status", F.when(stuck, "failed").otherwise(F.col("status"))
    )


def display_title(filings: DataFrame) -> DataFrame:
    """Custom title, else company, type and period, else the file name; and the kind of media by suffix."""
    def filled(name: str) -> Column:
        return F.when(F.col(name) != "", F.col(name))

    described = F.concat_ws(" · ", filled("company_name"), filled("filing_type"), filled("fiscal_period"))
    title = F.coalesce(filled("custom_title"), F.when(F.col("company_name") != "", described), F.col("original_name"))
    pdf = F.lower("original_name").endswith(".pdf")
    return filings.withColumn("title", title).withColumn("media", F.when(pdf, "pdf").otherwise("html"))


def turn_pairs(conversations: DataFrame) -> DataFrame:
    """messages from turns: a user turn and the assistant turn that follows it; system turns are left out."""
    answers = conversations.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = conversations.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    owner = F.when(F.col("conv_id") % 5 != 0, F.col("conv_id") % 7)
    return asked.join(answers, ["conv_id", "turn"]).select(
        F.col("conv_id").alias("session_id"), owner.alias("user_id"), F.col("turn").alias("message_id"), "question", "answer"
    )


def session_list(sessions: DataFrame, messages: DataFrame, filing: str | None = None) -> DataFrame:
    """Live sessions with their message counts, most recent first; a session without messages counts zero."""
    live = sessions.where("deleted_at IS NULL")
    if filing is not None:
        live = live.where(F.col("filing_id") == filing)
    counts = messages.groupBy("session_id").agg(F.count("*").alias("message_count"))
    listed = live.join(counts, "session_id", "left").na.fill(0, ["message_count"])
    recent = [c for c in ("updated_at", "created_at") if c in listed.columns]
    return listed.orderBy(*[F.desc_nulls_last(c) for c in recent], F.desc("session_id"))


def session_messages(messages: DataFrame) -> DataFrame:
    """The messages of every session with their place in it, from 1."""
    return messages.withColumn("place", F.row_number().over(Window.partitionBy("session_id").orderBy("message_id")))


def session_titles(messages: DataFrame) -> DataFrame:
    """The first question of each session, cut to 60 characters."""
    return messages.groupBy("session_id").agg(
        F.substring(strip(F.min_by("question", "message_id")), 1, 60).alias("title")
    )


def search(messages: DataFrame, sessions: DataFrame, user: int | None, text: str, limit: int | None = None) -> DataFrame:
    """The messages, newest first, of one's own live sessions whose question or answer contains the text, in any case; all of them unless a limit is given."""
    needle = F.lit("%" + text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%")
    hit = F.call_function("ilike", F.col("question"), needle) | F.call_function("ilike", F.col("answer"), needle)
    own = sessions.where(owned_by(F.lit(user).cast("bigint")) & F.col("deleted_at").isNull()).select("session_id", "filing_id")
    found = messages.where(hit).join(own, "session_id").orderBy(F.desc("message_id"), F.desc("session_id"))
    return found if limit is None else found.limit(limit)


def stored_citations(messages: DataFrame) -> DataFrame:
    """The stored list, or the primary page and quote where no list was stored."""
    primary = F.array(F.struct(F.col("page").cast("int").alias("page"), F.col("quote").alias("quote")))
    empty = F.array().cast("array<struct<page:int,quote:string>>")
    fallback = F.when(F.col("page").isNotNull() & (F.coalesce(F.col("quote"), F.lit("")) != ""), primary).otherwise(empty)
    return messages.withColumn("citations", F.when(F.size(F.coalesce(F.col("citations"), empty)) > 0, F.col("citations")).otherwise(fallback))


def feedback(changes: DataFrame) -> DataFrame:
    """Last feedback per message; clearing it leaves null. Values other than 1, -1 and null are not feedback."""
    valid = changes.where("feedback IS NULL OR feedback IN (1, -1)")
    return valid.groupBy("message_id").agg(F.max_by(F.struct("feedback"), "ts").alias("f")).select("message_id", "f.feedback")


def visible_to(rows: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    """Rows whose filing or session belongs to the asking workspace; others are as if absent.

    owners: (key, user_id); rows carry asking_user.
    """
    o = owners.select(F.col(key).alias("_key"), F.col("user_id").alias("_owner"))
    return rows.join(o, (F.col(key) == F.col("_key")) & F.col("asking_user").eqNullSafe(F.col("_owner")), "left_semi")


def askable(questions: DataFrame, filings: DataFrame) -> DataFrame:
    ready = filings.where("status = 'ready' AND deleted_at IS NULL").select("filing_id").distinct()
    return questions.join(ready, "filing_id", "left_semi")

