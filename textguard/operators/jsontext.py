"""JSON texts as arrays of tokens: walk them, and replace string values in place, all in built-in expressions.

The tokens of a text, white space among them, give the text again when joined. So a rewritten text keeps
its key order and the spelling of its numbers, and only what is replaced changes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from textguard.functions.arrays import bind, scan

TOKEN = r'"(?:[^"\\]++|\\.)*+"|[{}\[\],:]|[ \t\r\n]++|[^{}\[\],: \t\r\n"]++'
PATH_TYPE = "array<struct<key:string,pos:int>>"
LEAF_TYPE = f"struct<at:int,path:{PATH_TYPE},text:string>"


def tokens(text: Column) -> Column:
    """Tokens of a valid JSON text."""
    return F.regexp_extract_all(text, F.lit(f"(?s){TOKEN}"), F.lit(0))


def is_blank(token: Column) -> Column:
    return F.substring(token, 1, 1).isin(" ", "\t", "\r", "\n")


def string_of(literal: Column) -> Column:
    """What a JSON string literal stands for."""
    plain = F.substr(literal, F.lit(2), F.char_length(literal) - 2)
    read = F.try_variant_get(F.try_parse_json(F.when(F.contains(literal, F.lit("\\")), literal)), "$", "string")
    return F.when(F.contains(literal, F.lit("\\")), read).otherwise(plain)


def literal_of(text: Column) -> Column:
    """A text as a JSON string literal."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.substr(wrapped, F.lit(6), F.char_length(wrapped) - 6)


def string_leaves(parts: Column) -> Column:
    """``array<struct<at, path, text>>``: the string values of a JSON text given by its tokens, with the place of the token.

    One pass with the open containers as state: an object is a step with the key that was read last (null
    until then), an array a step with a position. Only tokens that open, close, part or are strings change it; the others are left out first.
    """
    nothing = F.array().cast(f"array<{LEAF_TYPE}>")
    step_type = "struct<key:string,pos:int>"

    def frame(key: Column, pos: Column) -> Column:
        return F.struct(key.cast("string").alias("key"), pos.cast("int").alias("pos")).cast(step_type)

    none = F.lit(None)

    def step(state: Column, token: Column) -> Column:
        at, stack, head = token["at"], state["stack"], token["head"]
        top = F.try_element_at(stack, F.lit(-1))
        below = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
        is_key = (head == '"') & top.isNotNull() & top["key"].isNull() & top["pos"].isNull()
        moved = (
            F.when(head == "{", F.concat(stack, F.array(frame(none, none))))
            .when(head == "[", F.concat(stack, F.array(frame(none, F.lit(0)))))
            .when(head.isin("}", "]"), below)
            .when(head == ",", F.concat(below, F.array(frame(none, top["pos"] + 1))))
            .when(is_key, F.concat(below, F.array(frame(string_of(token["t"]), none))))
            .otherwise(stack)
        )
        leaf = F.struct(at.alias("at"), stack.alias("path"), token["t"].alias("text")).cast(LEAF_TYPE)
        return F.struct(
            F.struct(moved.alias("stack")).alias("state"),
            F.when((head == '"') & ~is_key, F.array(leaf)).otherwise(nothing).alias("emit"),
        )

    start = F.struct(F.array().cast(PATH_TYPE).alias("stack"))
    items = F.transform(parts, lambda t, i: F.struct(t.alias("t"), F.substring(t, 1, 1).alias("head"), i.alias("at")))
    leaves = scan(F.filter(items, lambda t: t["head"].isin(*'{}[],"')), start, step, f"array<{LEAF_TYPE}>")["out"]
    return F.transform(leaves, lambda v: F.struct(v["at"].alias("at"), v["path"].alias("path"), string_of(v["text"]).alias("text")))


def with_tokens(parts: Column, changes: Column) -> Column:
    """The text of tokens without white space between them, with some replaced: ``changes`` is a map from place to token.

    The tokens between two changes are cut out as a whole, so each token and each change is read once.
    """

    def solid(run: Column) -> Column:
        return F.array_join(F.filter(run, lambda t: ~is_blank(t)), "")

    def between(changed: Column, j: Column) -> Column:
        return F.when(j > 0, F.get(changed, j - 1)["key"]).otherwise(F.lit(-1))

    def joined(changed: Column) -> Column:
        def one(change: Column, j: Column) -> Column:
            before, at = between(changed, j), change["key"]
            new = F.coalesce(change["value"], F.get(parts, at))
            return F.concat(solid(F.slice(parts, before + 2, at - before - 1)), new)

        last = between(changed, F.size(changed))
        rest = F.slice(parts, last + 2, F.greatest(F.size(parts) - last - 1, F.lit(0)))
        return F.concat(F.array_join(F.transform(changed, one), ""), solid(rest))

    return bind(F.array_sort(F.map_entries(changes)), joined)
