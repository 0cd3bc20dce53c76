"""Incidents in streams of shell commands: undone work and commands that fail again and again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_COMMAND, MOST_KEY, LEAST_FAILURES = 400, 120, 2

# Label, pattern at the start of a command, meaning; the first that matches wins.
UNDO = (
    ("git-checkout-file", r"git\s+checkout\s+(--\s|--theirs|--ours|HEAD\s+--)", "discarded working-tree changes"),
    ("git-restore", r"git\s+restore\b", "discarded working-tree changes"),
    ("git-reset-hard", r"git\s+reset\s+--hard\b", "threw away commits or changes"),
    ("git-revert", r"git\s+revert\b", "reverted a commit"),
    ("git-clean", r"git\s+clean\s+-[a-z]*f", "deleted untracked files"),
    ("git-stash-drop", r"git\s+stash\s+(drop|clear)\b", "discarded stashed work"),
    ("git-amend", r"git\s+commit\b.*--amend", "rewrote a commit that was wrong"),
    ("restore-backup", None, "restored from a backup"),
    ("rebase-abort", r"git\s+rebase\s+--abort\b", "abandoned a rebase"),
)
WRAPPERS = frozenset(("sudo", "command", "env", "time", "nohup"))
COPIERS = frozenset(("cp", "mv", "rsync", "install"))

# A here-document from the start of the text: what opens it, then its body up to the line that ends it.
HERE_DOCUMENT = r"""(?sm)\A(.*?<<-?\s*["']?(\w+)["']?).*?(?:^\2\s*$|\z)"""
SEPARATORS = r"&&|\|\||[;|&\n]"
SUBSTITUTION = r"\$\([^)]*\)|`[^`]*`"
KEPT_NOWHERE = r"""["']*(?:(?:/private)?/tmp/|/var/folders/)"""


def _led_by(words: frozenset[str], to: str) -> str:
    """A pattern of the assignments and ``words`` that lead a command, as far as ``to`` follows."""
    return rf"^\s*(?:(?:\w+=\S*|{'|'.join(sorted(words))})\s+(?={to}))*"


def run_commands(text: Column, led_by: frozenset[str] = WRAPPERS) -> Column:
    """The commands that a shell text runs, in order, without what leads each of them.

    The body of the first here-document is data and runs nothing.
    """
    shell = F.regexp_replace(text, HERE_DOCUMENT, "$1")
    return F.transform(F.split(shell, SEPARATORS), lambda c: F.regexp_replace(c, _led_by(led_by, r"\S"), ""))


def takes_backup_back(command: Column) -> Column:
    """Whether a single command copies from a backup to where work is kept.

    After its options are gone, a copier is followed by sources, one of which has the name of
    a backup, and by one destination; a backup that is the destination is only being made.
    """
    shape = rf"^(?:\S*/)?(?:{'|'.join(sorted(COPIERS))})\s+(?:\S+\s+)*?\S*\.(?:bak|backup|orig)\b\S*\s+(?:\S+\s+)*(?!{KEPT_NOWHERE})\S+\s*$"
    return F.regexp_replace(command, r"\s-\S*", "").rlike(shape)


def _begins(pattern: str):
    return lambda command: command.rlike(f"^(?:{pattern})")


def undo(command: Column) -> Column:
    """The label of the undo that a command runs, null for any other command; all in the JVM."""
    text = F.substring(command, 1, MOST_COMMAND)
    ran = run_commands(text)
    copied = run_commands(F.regexp_replace(text, SUBSTITUTION, ""), frozenset(("sudo", "command", "env")))
    label = F.lit(None).cast("string")
    for name, pattern, _ in reversed(UNDO):
        found = F.exists(copied, takes_backup_back) if pattern is None else F.exists(ran, _begins(pattern))
        label = F.when(found, name).otherwise(label)
    return F.when(command.rlike(r"git|\.(bak|backup|orig)"), label)  # most commands have none of the words


def undo_meaning(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, _, meaning in UNDO:
        out = F.when(label == name, meaning).otherwise(out)
    return out


def command_key(command: Column) -> Column:
    """White space as single blanks, cut to 120 characters: what makes two commands the same."""
    cut = F.regexp_replace(F.substring(command, 1, MOST_COMMAND), r"^\s+|\s+$", "")
    return F.substring(F.regexp_replace(cut, r"\s+", " "), 1, MOST_KEY)


def repeated_failures(events: DataFrame, session: str, key: str, at: str, tie: str, failed: Column) -> DataFrame:
    """Every failure of a command from the second on within a session: ``(session_id, key, at, count)``."""
    w = Window.partitionBy(session, key).orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    rows = events.filter(failed & F.col(key).isNotNull()).withColumn("count", F.count("*").over(w))
    return rows.filter(F.col("count") >= LEAST_FAILURES).select(F.col(session).alias("session_id"), F.col(key).alias("key"), F.col(at).alias("at"), "count")


def incidents(commands: DataFrame) -> DataFrame:
    """``(session_id, ts, kind, label, meaning, cmd, count)`` of ``commands(session_id, ts, seq, event, command)``.

    A failed command counts towards ``retry``; any other that undoes work is a ``revert``.
    """
    failed = F.col("event") == "failure"
    c = commands.filter(F.length("command") > 0).withColumn("cmd", F.substring("command", 1, MOST_COMMAND)).withColumn("key", command_key(F.col("command")))
    again = repeated_failures(c, "session_id", "key", "ts", "seq", failed)
    none = F.lit(None).cast("string")
    retry = again.select("session_id", F.col("at").alias("ts"), F.lit("retry").alias("kind"), none.alias("label"), none.alias("meaning"), F.col("key").alias("cmd"), "count")
    back = c.filter(~failed).withColumn("label", undo(F.col("cmd"))).filter(F.col("label").isNotNull())
    back = back.select("session_id", "ts", F.lit("revert").alias("kind"), "label", undo_meaning(F.col("label")).alias("meaning"), "cmd", F.lit(None).cast("long").alias("count"))
    return retry.unionByName(back)


def incident_digest(rows: DataFrame, most: int = 6, clip: int = 140) -> DataFrame:
    """``(session_id, n, digest)``: the first six incidents of each session and how many more."""
    line = F.concat_ws(" ", "kind", "label", F.substring("cmd", 1, clip))
    w = Window.partitionBy("session_id").orderBy("ts", "kind", "cmd")
    numbered = rows.withColumn("k", F.row_number().over(w))
    few = numbered.filter(F.col("k") <= most).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))).alias("l"))
    counts = rows.groupBy("session_id").agg(F.count("*").alias("n"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n…and "), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return counts.join(few, "session_id").select("session_id", "n", F.concat(F.array_join("l.line", "\n"), more).alias("digest"))


def session_baselines(sessions: DataFrame, lessons: DataFrame) -> DataFrame:
    """``sessions(session_id, started)`` with ``lessons_before``: how many lessons had been created when each began.

    Days before the session's own are counted as running totals of one row per day; only within
    its own day does a session meet single lessons, by an equi-join. A null start gives null.
    """
    made = lessons.filter(F.col("created_at").isNotNull()).select(F.to_date("created_at").alias("day"), "created_at")
    days = made.groupBy("day").agg(F.count("*").alias("n")).select("day", "n", F.lit(0).alias("asked"))
    asked = sessions.select(F.to_date("started").alias("day")).filter(F.col("day").isNotNull()).distinct().select("day", F.lit(0).cast("long").alias("n"), F.lit(1).alias("asked"))
    per = days.unionByName(asked).groupBy("day").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    before = per.withColumn("earlier", F.sum("n").over(Window.orderBy("day")) - F.col("n")).filter("asked = 1").select("day", "earlier")  # one row per day
    own = sessions.withColumn("day", F.to_date("started")).join(before, "day", "left")
    same = sessions.withColumn("day", F.to_date("started")).join(made, "day").filter(F.col("created_at") <= F.col("started")).groupBy("session_id").agg(F.count("*").alias("today"))
    return own.join(same, "session_id", "left").withColumn("lessons_before", F.col("earlier") + F.when(F.col("earlier").isNotNull(), F.coalesce("today", F.lit(0)))).drop("day", "earlier", "today")


def stop_gate(sessions: DataFrame, least_seconds: int = 180) -> DataFrame:
    """``(session_id, ask)`` of ``sessions(session_id, continuing, asked, started, stopped, lessons_before, lessons_now)``.

    A session is asked once for what it learned: not while a hook goes on, not twice, not when it
    was short, not when something was written or the start is unknown.
    """
    known = F.col("started").isNotNull() & F.col("lessons_before").isNotNull() & (F.col("lessons_now") >= 0)
    long = (F.unix_timestamp("stopped") - F.unix_timestamp("started")) >= least_seconds
    ask = ~F.coalesce("continuing", F.lit(False)) & ~F.coalesce("asked", F.lit(False)) & known & long & (F.col("lessons_now") <= F.col("lessons_before"))
    return sessions.select("session_id", F.coalesce(ask, F.lit(False)).alias("ask"))
