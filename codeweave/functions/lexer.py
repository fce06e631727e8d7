"""Masking of literals and comments in source text, one lexical state per file.

``mask_code(content, language)`` reads a file left to right with one regular
expression whose alternatives are comment, literal or other text, so a quote in a
comment or a comment sign in a string means nothing.  All repetitions are
possessive: the matcher neither backtracks nor recurses, whatever the length of
a literal.  Line breaks stay, so the masked text has the lines of the original:

* a literal becomes ``"\\u0002"``; where it goes on over a line break, the next
  line starts with ``\\u0001``;
* a comment becomes a space;
* the expressions inside f-strings and template literals stay as code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IN_LITERAL, LITERAL = "\u0001", "\u0002"

_BREAK = r"\r\n|[\n\r]"


def _quoted(q: str) -> str:
    return rf"{q}(?:[^{q}\\\n\r]++|\\(?:\r\n|.))*+{q}?"


def _block(q: str) -> str:
    return rf"{q * 3}(?:[^{q}\\]++|\\.|{q}(?!{q}{q}))*+(?:{q * 3}|\z)"


_C_COMMENT = r"//[^\n\r]*+|/\*(?:[^*]++|\*(?!/))*+(?:\*/|\z)"
_TEMPLATE = r"`(?:[^`\\$]++|\\.|\$\{(?:[^{}`]++|`[^`]*+`|\{[^{}]*+\})*+\}|\$)*+(?:`|\z)"
_JS_REGEX = r"(?<=[=(,:;!&|?{}\[\n][ \t]{0,4})/(?![*/])(?:[^\\/\[\n\r]++|\\.|\[(?:[^\]\\\n\r]++|\\.)*+\])++/[a-z]*+"
_RAW = r"(?<=R)\"([^(\s\\]{0,16})\((?:[^)]++|\)(?!\1\"))*+(?:\)\1\"|\z)"

TOKENS = {
    "Python": "|".join([r"#[^\n\r]*+", _block('"'), _block("'"), _quoted('"'), _quoted("'"), r"[^#\"']++"]),
    "JavaScript": "|".join([_C_COMMENT, _TEMPLATE, _quoted('"'), _quoted("'"), _JS_REGEX, r"[^/\"'`]++", "/"]),
    "Java": "|".join([_C_COMMENT, _block('"'), _quoted('"'), _quoted("'"), r"[^/\"']++", "/"]),
    "C++": "|".join([_C_COMMENT, _RAW, _quoted('"'), r"(?<![0-9a-fA-F])" + _quoted("'"), r"[^/\"']++", "[/']"]),
}
#: Tokens of a literal with expressions: escaped braces, an expression, a line break.
_HOLES = {"Python": r"\{\{|\}\}|\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}|" + _BREAK,
          "JavaScript": r"\$\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}|" + _BREAK}


def _breaks(t: Column) -> Column:
    """A literal without expressions."""
    kept = F.regexp_replace(F.regexp_replace(t, r"[^\n\r]++", ""), f"({_BREAK})", "$1" + IN_LITERAL)
    return F.concat(F.lit(f'"{LITERAL}"'), kept)


def _with_holes(t: Column, language: str) -> Column:
    parts = F.regexp_extract_all(t, F.lit("(?s)" + _HOLES[language]), F.lit(0))
    inner = F.transform(parts, lambda p: F.when(p.rlike(r"^[\n\r]"), F.concat(p, F.lit(IN_LITERAL)))
                        .when(p.isin("{{", "}}"), F.lit(""))
                        .otherwise(F.concat(F.lit(" "), F.regexp_replace(
                            F.regexp_replace(p, r"^\$?\{|\}$", ""), _quoted('"') + "|" + _quoted("'"), f'"{LITERAL}"'),
                            F.lit(" "))))
    return F.concat(F.lit(f'"{LITERAL}"'), F.array_join(inner, ""))


def _mask(content: Column, language: str) -> Column:
    tokens = F.regexp_extract_all(content, F.lit("(?s)" + TOKENS[language]), F.lit(0))
    comment = r"^#" if language == "Python" else r"^/[/*]"

    def one(t: Column, before: Column) -> Column:
        plain = ~t.rlike("^[\"'`]") & ~t.rlike(r"^/.")
        out = F.when(t.rlike(comment), F.concat(F.lit(" "), F.regexp_replace(t, r"[^\n\r]++", "")))
        if language == "Python":
            out = out.when(t.rlike("^[\"']") & before.rlike(r"(?i)(?:^|\W)(?:f|rf|fr)$"), _with_holes(t, language))
            plain = ~t.rlike("^[\"']")
        if language == "JavaScript":
            out = out.when(t.startswith("`"), _with_holes(t, language))
        return out.when(plain, t).otherwise(_breaks(t))

    # (inside the function the token list would be made anew for every token)
    return F.array_join(F.zip_with(tokens, F.concat(F.array(F.lit("")), tokens), one), "")


def mask_code(content: Column, language: Column) -> Column:
    """Masked text of a file in one of the languages of ``TOKENS``; other
    languages are returned as they are."""
    out = None
    for name in TOKENS:
        masked = _mask(content, name)
        out = F.when(language == name, masked) if out is None else out.when(language == name, masked)
    return out.otherwise(content)


def _same_length(t: Column) -> Column:
    """A literal, every character but line breaks replaced."""
    return F.regexp_replace(t, r"[^\n\r]", LITERAL)


def _template(t: Column) -> Column:
    """A template literal at its own length, expressions kept."""
    parts = F.regexp_extract_all(t, F.lit(r"(?s)\$\{[^{}]*+(?:\{[^{}]*+\}[^{}]*+)*+\}|[^$]++|\$"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("${"), F.concat(
        F.lit(LITERAL + "("), F.regexp_replace(F.regexp_replace(p, r"^\$\{|\}$", ""), _quoted('"') + "|" + _quoted("'"),
                                               LITERAL), F.lit(")"))).otherwise(_same_length(p))), "")


def _in_place(language: str):
    def one(t: Column) -> Column:
        last = F.substring_index(F.translate(t, "\r", "\n"), "\n", -1)
        masked = F.when(t.startswith("//"), F.lit("")).when(t.startswith("/*"), F.concat(
            F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(last)), r"[^\n\r]++", ""),
            F.repeat(F.lit(" "), F.length(last))))
        if language == "JavaScript":
            masked = masked.when(t.startswith("`"), _template(t))
        return masked.when(t.rlike("^[\"'`]") | t.rlike(r"^/."), _same_length(t)).otherwise(t)
    return one


def mask_in_place(content: Column, language: Column) -> Column:
    """Masked text of a brace language in which every character keeps its line and
    column: literals are runs of ``\\u0002``, comments blanks or, where nothing
    follows on their line, cut off, preprocessor lines emptied (expressions of templates stay, in
    parentheses; a literal inside one is one character)."""
    out = None
    for name in ("JavaScript", "Java", "C++"):
        tokens = F.regexp_extract_all(content, F.lit("(?s)" + TOKENS[name]), F.lit(0))

        masked = F.array_join(F.transform(tokens, _in_place(name)), "")
        if name == "C++":
            masked = F.regexp_replace(masked, r"(?m)^[ \t]*+#(?:[^\n\r\\]++|\\(?![\n\r]))*+", "")
        out = F.when(language == name, masked) if out is None else out.when(language == name, masked)
    return out.otherwise(content)


def split_arguments(text: Column, angles: Column) -> Column:
    """Top-level comma parts of a parameter list, at any nesting depth.  ``text``
    starts after the opening parenthesis; what follows the closing one does not
    matter.  ``angles``: whether ``<`` and ``>`` are brackets (Java, C++)."""
    tokens = F.regexp_extract_all(text, F.lit(
        "(?s)" + _quoted('"') + "|" + _quoted("'") + r"|[()\[\]{}<>,]|[^()\[\]{}<>,\"']++"), F.lit(0))
    state = F.struct(F.lit(0).alias("d"), F.lit("").alias("cur"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens = t.isin("(", "[", "{") | (angles & (t == "<"))
        closes = t.isin(")", "]", "}") | (angles & (t == ">"))
        cut = (s["d"] == 0) & (t == ",")
        end = (s["d"] == 0) & t.isin(")", "]", "}")
        d = F.when(s["d"] < 0, s["d"]).when(end, F.lit(-1)).when(opens, s["d"] + 1).when(
            closes & (s["d"] > 0), s["d"] - 1).otherwise(s["d"])
        live = s["d"] >= 0
        return F.struct(d.alias("d"),
                        F.when(live & (cut | end), F.lit("")).when(live, F.concat(s["cur"], t)).otherwise(s["cur"]).alias("cur"),
                        F.when(live & (cut | end), F.concat(s["out"], F.array(s["cur"]))).otherwise(s["out"]).alias("out"))

    done = F.aggregate(tokens, state, step)
    parts = F.transform(F.concat(done["out"], F.array(done["cur"])), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")
