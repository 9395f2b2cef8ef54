"""Where JSON text stops being JSON, by an automaton over its characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States: a value is due (also: or the end of an array), a name is due (or the end of an object), inside a string that is a
# name or a value, after its backslash, hex digits of an escape, a colon is due, after a value, inside a number or word.
VALUE, VALUE_OR_END, NAME_OR_END, NAME, IN_NAME, IN_TEXT, ESCAPE_NAME, ESCAPE_TEXT, HEX_NAME, HEX_TEXT, COLON, AFTER, WORD = range(13)
_TOKEN = r"^(-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?|true|false|null|NaN|-?Infinity)"
#: What a JSON parser says went wrong.
MESSAGES = {
    "value": "Expecting value", "name": "Expecting property name enclosed in double quotes", "colon": "Expecting ':' delimiter",
    "comma": "Expecting ',' delimiter", "open": "Unterminated string starting at", "control": "Invalid control character at",
    "escape": "Invalid \\escape", "hex": "Invalid \\uXXXX escape", "extra": "Extra data",
}


def json_error(text: Column) -> Column:
    """Struct (pos, line, col, message) of the first place at which a text is not JSON; null if it is.

    pos counts characters from 0, line and col from 1; a string that never
    ends is reported where it begins, an ended text where it ends, and after a
    comma too many what should have followed it.
    """
    chars = F.split(F.concat(text, F.lit("\n")), "")  # a last line end closes a number at the end of the text
    start = F.struct(
        F.lit(VALUE).alias("state"), F.lit("").alias("open"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.lit("").alias("word"), F.lit(0).alias("hex"),
        F.lit(-1).alias("pos"), F.lit("").alias("kind"),
    )

    def step(s: Column, c: Column) -> Column:
        state, at = s["state"], s["at"]
        blank, top = c.isin(" ", "\t", "\n", "\r"), F.substring(s["open"], -1, 1)
        in_string = state.isin(IN_NAME, IN_TEXT)
        letter = c.rlike(r"^[A-Za-z0-9+.-]$")
        token = F.regexp_extract(s["word"], _TOKEN, 1)
        # the end of a word or number comes with the next character, which is then taken as one after a value
        word_ends = (state == WORD) & ~letter
        bad_word = word_ends & (token != s["word"])
        after = (state == AFTER) | (word_ends & ~bad_word)
        value_due = state.isin(VALUE, VALUE_OR_END)
        name_due = state.isin(NAME_OR_END, NAME)
        closes = ((c == "]") & (top == "[")) | ((c == "}") & (top == "{"))
        ends = closes & (after | ((state == VALUE_OR_END) & (c == "]")) | ((state == NAME_OR_END) & (c == "}")))
        comma = after & (c == ",") & (top != "")
        opens = value_due & c.isin("[", "{")
        kind = (
            F.when(in_string & c.rlike(r"^[\x00-\x1f]$"), "control")
            .when(state.isin(ESCAPE_NAME, ESCAPE_TEXT) & ~c.isin('"', "\\", "/", "b", "f", "n", "r", "t", "u"), "escape")
            .when(state.isin(HEX_NAME, HEX_TEXT) & ~c.rlike("^[0-9a-fA-F]$"), "hex")
            .when(bad_word, F.when(token == "", "value").when(top == "", "extra").otherwise("comma"))
            .when(value_due & ~blank & ~(c.isin("[", "{", '"') | letter) & ~ends, "value")
            .when(name_due & ~blank & (c != '"') & ~ends, "name")
            .when((state == COLON) & ~blank & (c != ":"), "colon")
            .when(after & ~blank & ~comma & ~ends, F.when(top == "", "extra").otherwise("comma"))
            .otherwise("")
        )
        pos = (
            F.when(bad_word, s["begin"] + F.length(token)).when(state.isin(ESCAPE_NAME, ESCAPE_TEXT), at - 1)
            .when(state.isin(HEX_NAME, HEX_TEXT), at - s["hex"]).otherwise(at)
        )
        following = (
            F.when((state == IN_NAME) & (c == '"'), COLON).when((state == IN_TEXT) & (c == '"'), AFTER)
            .when(in_string & (c == "\\"), state + (ESCAPE_NAME - IN_NAME)).when(in_string, state)
            .when(state == ESCAPE_NAME, F.when(c == "u", HEX_NAME).otherwise(IN_NAME)).when(state == ESCAPE_TEXT, F.when(c == "u", HEX_TEXT).otherwise(IN_TEXT))
            .when(state.isin(HEX_NAME, HEX_TEXT), F.when(s["hex"] == 4, state - (HEX_NAME - IN_NAME)).otherwise(state))
            .when(ends, AFTER).when(comma, F.when(top == "{", NAME).otherwise(VALUE)).when(opens, F.when(c == "[", VALUE_OR_END).otherwise(NAME_OR_END))
            .when(value_due & (c == '"'), IN_TEXT).when(name_due & (c == '"'), IN_NAME).when((state == COLON) & (c == ":"), VALUE)
            .when((value_due | (state == WORD)) & letter, WORD).when(after, AFTER).otherwise(state)
        )
        stack = F.when(ends, F.substring(s["open"], F.lit(1), F.length(s["open"]) - 1)).when(opens, F.concat(s["open"], c)).otherwise(s["open"])
        moved = F.struct(
            following.alias("state"), stack.alias("open"), (at + 1).alias("at"),
            F.when((value_due | name_due) & ~blank, at).otherwise(s["begin"]).alias("begin"),
            F.when(letter & value_due, c).when(letter & (state == WORD), F.concat(s["word"], c)).otherwise("").alias("word"),
            F.when(state.isin(HEX_NAME, HEX_TEXT), s["hex"] + 1).otherwise(1).alias("hex"),
            F.when(kind != "", pos).otherwise(-1).alias("pos"), kind.alias("kind"),
        )
        return F.when(s["kind"] != "", s).otherwise(moved)

    def report(s: Column) -> Column:
        open_string = s["state"].isin(IN_NAME, IN_TEXT, ESCAPE_NAME, ESCAPE_TEXT, HEX_NAME, HEX_TEXT)
        length = F.length(text)
        at_end = s["kind"].isin("control", "escape") & (s["at"] > length)  # the added line end inside a string that is open
        kind = (
            F.when(open_string & ((s["kind"] == "") | (s["pos"] >= length) | at_end), "open").when(s["kind"] != "", s["kind"])
            .when(s["state"].isin(VALUE, VALUE_OR_END), "value").when(s["state"].isin(NAME, NAME_OR_END), "name").when(s["state"] == COLON, "colon")
            .when(s["open"] != "", "comma")
        )
        pos = F.when(kind == "open", s["begin"]).when(s["kind"] != "", s["pos"]).otherwise(length)
        before = F.substring(text, F.lit(1), pos)
        line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
        col = F.length(F.substring_index(before, "\n", -1)) + 1
        said = F.create_map(*(F.lit(x) for pair in MESSAGES.items() for x in pair))
        return F.when(kind.isNotNull(), F.struct(pos.alias("pos"), line.alias("line"), col.alias("col"), said[kind].alias("message")))

    return F.aggregate(chars, start, step, report)
