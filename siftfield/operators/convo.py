"""Conversations and requests: messages, histories, intents, routing, frames, segments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftfield.functions.text import SPACES, Lexicon, captured, contains_any, first_match, joined, n_words, words
from siftfield.operators.lines import settled

MESSAGE_PATHS = ("$.body.messages[*].content", "$.messages[*].content", "$.message", "$.body.message", "$.input", "$.query")
REPLY_PATHS = ("$.choices[0].message.content", "$.reply", "$.output", "$.response", "$.result", "$.content", "$.message", "$.text")


#: Keys that a message may stand under, in order.
MESSAGE_KEYS = ("content", "text", "message", "query", "prompt")


def deep_message(json: Column, depth: int = 3, keys: Sequence[str] = MESSAGE_KEYS) -> Column:
    """The first message in JSON text, depth first: of an object its own by the keys' order, else what its values
    hold, in their order; of a list what its items hold; ``depth`` levels down.  Numbers aren't messages, and a string
    that is itself JSON counts as what it says."""
    own = F.from_json(json, ", ".join(f"`{k}` variant" for k in keys))
    said = F.coalesce(*(F.when(F.schema_of_variant(own[k]) == "STRING", F.nullif(F.trim(F.try_variant_get(own[k], "$", "string")), F.lit(""))) for k in keys))
    if depth == 0:
        return F.when(json.startswith("{"), said)
    first = lambda parts: F.get(F.filter(F.transform(parts, lambda x: deep_message(x, depth - 1, keys)), lambda x: x.isNotNull()), F.lit(0))
    inside = F.filter(F.map_values(F.from_json(json, "map<string,string>")), lambda x: x.startswith("{") | x.startswith("["))
    items = F.filter(F.from_json(json, "array<string>"), lambda x: x.startswith("{") | x.startswith("["))
    return F.when(json.startswith("{"), F.coalesce(said, first(inside))).when(json.startswith("["), first(items))


def user_message(payload: Column) -> Column:
    """The last message of a request, by the first path that has one; else the first that a search three levels deep finds."""
    doc = F.try_parse_json(payload)

    def last(path: str) -> Column:
        if "[*]" not in path:
            return F.nullif(F.trim(F.try_variant_get(doc, path, "string")), F.lit(""))
        base, field = path.split("[*].")
        found = F.filter(F.transform(F.coalesce(F.try_variant_get(doc, base, "array<variant>"), F.array().cast("array<variant>")), lambda m: F.try_variant_get(m, f"$.{field}", "string")), lambda t: t.isNotNull() & (F.trim(t) != ""))
        return F.try_element_at(found, F.lit(-1))

    return F.coalesce(*(last(p) for p in MESSAGE_PATHS), F.when(doc.isNotNull(), deep_message(F.trim(payload, F.lit(" \n\t\r")))))


def reply_content(payload: Column) -> Column:
    """The reply by ordered keys, else the whole payload."""
    doc = F.try_parse_json(payload)
    return F.coalesce(*(F.nullif(F.try_variant_get(doc, p, "string"), F.lit("")) for p in REPLY_PATHS), payload)


def last_user_turn(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    return turns.filter("role = 'user'").groupBy(key).agg(F.max_by("text", "turn").alias("last_user"))


def from_end(key: str = "conv_id") -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc("turn")))


def history(turns: DataFrame, last: int = 8, key: str = "conv_id") -> DataFrame:
    """The last turns; roles other than user and assistant go after the cut."""
    return turns.withColumn("back", from_end(key)).filter((F.col("back") <= last) & F.col("role").isin("user", "assistant")).drop("back")


def before_last(turns: DataFrame, n: int = 5, longest: int = 300, key: str = "conv_id") -> DataFrame:
    rows = turns.withColumn("back", from_end(key)).filter(F.col("back").between(2, n + 1))
    return rows.withColumn("text", F.substring("text", 1, longest)).drop("back")


def with_previous_question(turns: DataFrame, longest: int = 150, key: str = "conv_id") -> DataFrame:
    """Add ``previous`` (the user's turn before, cut) and ``enriched`` (both in one) to user turns."""
    before = Window.partitionBy(key).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    rows = turns.withColumn("previous", F.substring(F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before), 1, longest))
    return rows.filter("role = 'user'").withColumn("enriched", F.concat_ws(" | ", "previous", "text"))


def rolling_memory(turns: DataFrame, last: int = 12, key: str = "conv_id") -> DataFrame:
    """key, memory: the last messages of each sender, in order (role: text)."""
    rows = turns.withColumn("back", from_end(key)).filter(F.col("back") <= last)
    entry = F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line"))
    return rows.groupBy(key).agg(F.collect_list(entry).alias("x")).select(key, joined(F.col("x"), "line", "\n").alias("memory"))


def days_in(text: Column, most: int = 7) -> Column:
    """Days a question is about: tomorrow 2, today 1, the next N (``most`` at most)."""
    low = F.lower(text)
    n = F.try_to_number(F.nullif(F.regexp_extract(low, r"pr[oó]ximos?\s+(\d{1,3})\s+d[ií]as", 1), F.lit("")), F.lit("999")).cast("int")
    return F.when(low.contains("mañana"), 2).when(low.contains("hoy"), 1).when(n.isNotNull(), F.least(n, F.lit(most)))


def intent(text: Column, weather: Sequence[str], product: Sequence[str], growing: Sequence[str], places: Lexicon, place_patterns: Sequence[str] = (), stop_words: Sequence[str] = (), default_place: str | None = None, default_days: int | None = None) -> Column:
    """struct(needs_weather, needs_rag, location, days, query_type); later groups overwrite the type."""
    w, p, g = contains_any(text, weather), contains_any(text, product), contains_any(text, growing)
    place = F.coalesce(first_match(text, places), *([captured(text, place_patterns, stop_words)] if place_patterns else []), F.lit(default_place))
    kind = F.when(g, "growing").when(p, "product").when(w, "weather").otherwise("general")
    return F.struct(w.alias("needs_weather"), (p | g).alias("needs_rag"), place.alias("location"), F.coalesce(days_in(text), F.lit(default_days)).cast("int").alias("days"), kind.alias("query_type"))


def tools(query: Column, history_text: Column, gate: Sequence[str], product: Sequence[str], others: Lexicon, most: int = 3) -> Column:
    """Sources a question needs, in order: documents (by words of query and history; a question about
    weeds leaves the history out), others by keyword, an expert where none or several matched."""
    context = F.when(contains_any(query, gate), query).otherwise(F.concat_ws(" ", query, history_text))
    found = F.array_compact(F.array(F.when(contains_any(context, product), "rag"), *(F.when(contains_any(query, ws), name) for name, ws in others)))
    found = F.when(F.size(found) == 0, F.array(F.lit("rag"), F.lit("expert"))).when((F.size(found) > 1) & ~F.array_contains(found, "expert"), F.array_append(found, F.lit("expert"))).otherwise(found)
    return F.slice(found, 1, most)


def routed(text: Column, pipelines: Lexicon, default: str = "help") -> Column:
    return first_match(text, pipelines, default)


def usage(prompt: Column, reply: Column) -> Column:
    """Estimated tokens of a response: two per word of the prompt, one per word of the reply, their sum as three per word."""
    return F.struct((n_words(prompt) * 2).alias("prompt_tokens"), n_words(reply).alias("completion_tokens"), (n_words(reply) * 3).alias("total_tokens"))


def envelope(request_id: Column, model: str, reply: Column, prompt: Column) -> Column:
    return F.to_json(F.struct(request_id.alias("id"), F.lit(model).alias("model"), F.array(F.struct(F.struct(F.lit("assistant").alias("role"), reply.alias("content")).alias("message"))).alias("choices"), usage(prompt, reply).alias("usage")))


def frames(df: DataFrame, keys: Sequence[str], text_col: str, size: int = 3) -> DataFrame:
    """keys, frame (from 0), text: a few words each, all but the last with a space behind."""
    ws = words(F.col(text_col))
    n = F.size("ws")
    cut = F.transform(F.sequence(F.lit(0), n - 1, F.lit(size)), lambda i: F.concat(F.array_join(F.slice(F.col("ws"), i + 1, size), " "), F.when(i + size < n, " ").otherwise("")))
    return df.withColumn("ws", ws).filter(n > 0).select(*keys, F.posexplode(cut).alias("frame", "text"))


def plain_text(text: Column) -> Column:
    """Basic Markdown as plain text: no tables, rules or heading marks, bullets as dashes."""
    out = F.regexp_replace(text, r"(?d)\|.*\|", "")
    out = F.regexp_replace(out, r"(?md)^-{3,}$", "")
    out = F.regexp_replace(out, r"(?md)^#+\s*", "")
    out = F.regexp_replace(out, r"(?md)^[\s\-*]+", "- ")
    out = F.regexp_replace(out, r"\n{3,}", "\n\n")
    return F.trim(out, F.lit(" \n\t\r"))


def segments_of(text: Column, limit: int = 1500) -> Column:
    """Segments of at most ``limit`` characters, cut at the last newline, else space, in the last 40 percent.

    One pattern that starts where its last match ended: all that is left if it fits, else up to the farthest
    newline, else up to the farthest space, else ``limit`` characters; space between segments goes.
    """
    least = max(int(limit * 0.6), 1)
    cut = rf"(?s)[{SPACES}]*+(.{{1,{limit}}}\z|.{{{least},{limit - 1}}}(?=\n)|.{{{least},{limit - 1}}}(?= )|.{{{limit}}})" if limit > least else rf"(?s)[{SPACES}]*+(.{{1,{limit}}}\z|.{{{limit}}})"
    ends = rf"^[{SPACES}]+|[{SPACES}]+\z"
    whole = F.regexp_replace(F.coalesce(text, F.lit("")), ends, "")
    found = F.transform(F.regexp_extract_all(whole, F.lit(cut), F.lit(1)), lambda x: F.regexp_replace(x, ends, ""))
    return F.when(F.length(whole) <= limit, F.array(whole)).otherwise(found)


def segments(df: DataFrame, keys: Sequence[str], text_col: str, limit: int = 1500) -> DataFrame:
    """keys, part (from 1), parts, text with ``[i/n]`` in front where a message has several segments."""
    rows = settled(df.select(*keys, F.col(text_col).alias("text_")), cut_=segments_of(F.col("text_"), limit)).select(*keys, F.size("cut_").alias("parts"), F.posexplode("cut_").alias("pos", "piece"))
    mark = F.when(F.col("parts") > 1, F.concat(F.lit("["), (F.col("pos") + 1).cast("string"), F.lit("/"), F.col("parts").cast("string"), F.lit("] "))).otherwise("")
    return rows.select(*keys, (F.col("pos") + 1).alias("part"), "parts", F.concat(mark, F.col("piece")).alias("text"))


def chosen_source(answers: DataFrame, key: str, order: Sequence[str] = ("rag", "expert", "weather", "prices"), shortest: int = 50, excerpt: int = 800) -> DataFrame:
    """key, n, source (the first by priority), answer (the only one with its source below, else excerpts of all)."""
    rank = F.array_position(F.array(*(F.lit(s) for s in order)), F.col("source"))
    good = answers.filter(F.length(F.trim("text")) > shortest).withColumn("p", F.when(rank > 0, rank).otherwise(len(order) + 1))
    x = F.struct("p", "source", "text")
    rows = good.groupBy(key).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(x)).alias("x"))
    one = F.concat(F.col("x")[0]["text"], F.lit("\n\nFuente: "), F.col("x")[0]["source"])
    several = F.array_join(F.transform("x", lambda a: F.concat(F.lit("["), a["source"], F.lit("] "), F.substring(a["text"], 1, excerpt))), "\n")
    return rows.select(key, "n", F.col("x")[0]["source"].alias("source"), F.when(F.col("n") == 1, one).otherwise(several).alias("answer"))


def prompts(requests: DataFrame, key: str, system: str, weather: DataFrame, documents: DataFrame, turns: DataFrame) -> DataFrame:
    """key, messages (array of role and content): system text with a weather and a documents block, then
    the history.  weather: key, block; documents: key, context; turns: key, turn, role, text."""
    past = turns.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("past"))
    rows = requests.select(key).join(weather, key, "left").join(documents, key, "left").join(past, key, "left")
    head = F.concat_ws("\n\n", F.lit(system), F.coalesce("block", F.lit("Sin datos del tiempo.")), F.coalesce("context", F.lit("Sin documentos.")))
    first = F.array(F.struct(F.lit("system").alias("role"), head.alias("content")))
    return rows.select(key, F.when(F.col("past").isNull(), first).otherwise(F.concat(first, F.col("past"))).alias("messages"))


def footer(flags: dict[str, Column]) -> Column:
    used = F.array_join(F.array_compact(F.array(*(F.when(c, n) for n, c in flags.items()))), " + ")
    return F.when(used != "", F.concat(F.lit("Fuentes: "), used))


def normalised(turns: DataFrame) -> DataFrame:
    """Roles system, user and assistant stay, others become user; blank messages go."""
    role = F.lower(F.trim("role"))
    return turns.filter(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("role", F.when(role.isin("system", "user", "assistant"), role).otherwise("user"))


def with_system_first(messages: Column, system: str) -> Column:
    """Put a system message in front of an array of (role, content) that has none."""
    own = F.array(F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")))
    return F.when(F.exists(messages, lambda m: m["role"] == "system"), messages).otherwise(F.concat(own, messages))
