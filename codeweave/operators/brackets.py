"""Entities of brace languages from the brackets of a whole file.

A masked file (``lexer.mask_in_place``) is cut into one row per structural mark,
``( ) [ ] { } ; ,``, ``=>`` or a line break that ends a statement, with the text
before it.  Running sums give each mark its line, column and bracket depth, all
three kinds of brackets at once.  Marks of one depth form a window partition, in
which a bracket's partner is the next row and the end of an expression the next
mark that can end one: no tree is built, no lines are compared in pairs, and
several definitions on a line are as good as several lines.

Places are ``line * LINE + column``; an entity reaches from ``pos`` to ``end_pos``
(exclusive), and enclosure is decided on these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.lexer import LITERAL, mask_in_place, split_arguments
from ..functions.text import py_strip, split_lines, strip_chars
from .lines import FILE_KEY, innermost_enclosing

LINE = 1 << 32
_ID = r"[A-Za-z_$][\w$]*+"
_WORDS = "|".join
#: a line break ends a JavaScript statement between something that can end one and something that can begin one
_ENDS = (r"(?<=[\w$)\]}\"" + LITERAL + r"][ \t]{0,80})(?:\r\n|[\n\r])"
         r"(?=\s*+(?!(?:instanceof|in|of|as|extends|implements|from)\b)[\w$@#" + LITERAL + r"])")
_CONTROL = "if|for|while|switch|catch|function|return|with|synchronized|try|else|do|new|throw|case|await|typeof|super"

#: Text before the '(' of a JavaScript function or method.
_JS_FUNCTION = r"(?<![\w$.])(?:async\s+)?function\b\s*+\*?\s*+(" + _ID + r")\s*+$"
_JS_METHOD = (r"(?s)^\s*+(?:(?:public|private|protected|static|async|get|set|readonly|override|abstract)\s+)*+\*?\s*+"
              r"(?!(?:" + _CONTROL + r")\b)(#?" + _ID + r")\s*+$")
_DECLARED = r"(?:^|[^\w$.])(?:const|let|var)\s+(" + _ID + r")\s*+(?::[^=]*+)?=(?![=>])"
_DECLARED_NEXT = r"^\s*+(" + _ID + r")\s*+(?::[^=]*+)?=(?![=>])"
#: Java: type and name; a constructor has a name only.
_JAVA_METHOD = (r"(?s)^(?!\s*+(?:return|new|throw|else|case|assert|yield|do|try|record|package|import)\b)"
                r"[\w\s$.<>\[\]?@]*[\w$>\]]\s+(?!(?:" + _CONTROL + r")\b)(" + _ID + r")\s*+$")
_JAVA_CONSTRUCTOR = (r"(?s)^\s*+(?:@[\w.]+\s+)*+(?:(?:public|protected|private)\s+)?+(?:<[^>]*+>\s*+)?+([A-Z][\w$]*+)\s*+$")
#: C++: what may stand before a declarator, and the declarator.
_CPP_LEAD = (r"(?s)^\s*+(?:(?:public|private|protected)\s*+:(?!:)\s*+)*+"
             r"(?:template\s*+<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*+>\s*+)*+")
_CPP_COMMA = r"(?s)^(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*+>\s*+"
_CPP_NAME = r"~\s*+[A-Za-z_]\w*+|operator\s*+(?:\(\s*+\)|\[\s*+\]|,|[^\s\w(]+|[\w:]+(?:\s*[*&]+)?)|[A-Za-z_]\w*+"
_CPP_FUNCTION = (r"(?s)^(?!(?:return|else|if|for|while|switch|case|new|delete|throw|do|goto|using|typedef|co_return|catch)\b)"
                 r"(?:[\w\s:<>*&~\[\]]*?[\s*&>])??(?:[A-Za-z_]\w*\s*+(?:<[^<>]*>\s*+)?::\s*+)*"
                 r"(?!(?:if|for|while|switch|catch|return|sizeof|alignas|decltype|__attribute__)\b)(" + _CPP_NAME + r")\s*+$")
#: a declaration without a body: a type, then a name
_CPP_DECLARED = (r"(?s)^(?!(?:return|else|case|new|delete|throw|do|goto|co_return|co_await|co_yield)\b)"
                 r"(?:\w++(?:::\w++)*+(?:<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*+>)?(?:\s*+[*&]++\s*+|\s++))+"
                 r"(?:[A-Za-z_]\w*\s*+::\s*+)*(?:" + _CPP_NAME + r")\s*+$")
_CPP_TAIL = r"(?s)^(?:\s|const\b|noexcept\b|override\b|final\b|mutable\b|volatile\b|&)*+(?:->[^;]*+)?$"
_CLASS = {
    "JavaScript": r"(?s)^\s*+(?:export\s+)?+(?:default\s+)?+(?:abstract\s+)?+(class)\s+(" + _ID + r")",
    "Java": r"(?<![\w$.])(class)\s+(" + _ID + r")",
    "C++": r"(?s)(?<![<,\w])(?<!enum\s{1,9})(?<![<,]\s{1,9})((?:class|struct))\s+([A-Za-z_]\w*+)(?=\s*+(?:final\s*+)?(?::(?!:)|$))",
}
_CALL = r"(?<![\w$])((?:new\s+)?)((?:\.\s*+)?" + _ID + r"(?:\s*+\.\s*+" + _ID + r")*)\s*+$"
_OPENS, _CLOSES, _STOPS = ("(", "[", "{"), (")", "]", "}"), (";", "\n")


def _place(line: Column, col: Column) -> Column:
    return line.cast("long") * LINE + col


def _last_line(text: Column) -> Column:
    return F.substring_index(F.translate(text, "\r", "\n"), "\n", -1)


def _breaks(text: Column) -> Column:
    """Number of line breaks (``\\r\\n`` is one)."""
    plain = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    return F.length(plain) - F.length(F.translate(plain, "\r\n", ""))


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(" \t\n\r\f\x0b"))


def _after(line: Column, col: Column, text: Column) -> Column:
    """Place behind ``text`` that begins at (line, col)."""
    n = _breaks(text)
    last = F.length(_last_line(text))
    return _place(line + n, F.when(n > 0, last).otherwise(col + last))


def _line_of(place: Column) -> Column:
    return F.shiftright(place, 32).cast("int")


def marks(files: DataFrame) -> DataFrame:
    """One row per structural mark of ``files (FILE_KEY, language, masked)``."""
    js, cpp = F.col("language") == "JavaScript", F.col("language") == "C++"

    def cut(ends: str, text: str) -> Column:
        plain = r"[^()\[\]{};,=\n\r" + ("o" if text else "") + r"]++"
        return F.regexp_extract_all("masked", F.lit(
            rf"(?s)(?:{plain}{text}|=(?!>)|(?!{ends})[\n\r])*+(?:=>|[()\[\]{{}};,]|{ends}|\z)"), F.lit(0))

    operator = r"|\boperator\s*+(?:\(\s*+\)|\[\s*+\]|,)|o"
    parts = F.when(js, cut(_ENDS, "")).when(cpp, cut(r"(?!)", operator)).otherwise(cut(r"(?!)", ""))
    rows = files.select(*FILE_KEY, "language", "n_lines", F.posexplode(parts).alias("i", "part"))
    mark = (F.when(F.col("part").endswith("=>"), F.lit("=>")).when(F.col("part").rlike(r"[\n\r]\z") & js, F.lit("\n"))
            .when(F.col("part").rlike(r"[()\[\]{};,]\z"), F.right("part", F.lit(1))).otherwise(F.lit("")))
    rows = rows.withColumn("mark", mark).withColumn("before", F.when(
        F.col("mark") == "\n", F.expr(r"left(part, length(part) - IF(endswith(part, '\r\n'), 2, 1))")).otherwise(
        F.expr("left(part, length(part) - length(mark))")))
    in_file = Window.partitionBy(*FILE_KEY).orderBy("i")
    so_far, before = (in_file.rowsBetween(Window.unboundedPreceding, k) for k in (0, -1))
    rows = rows.withColumn("breaks", _breaks(F.col("part"))).withColumn("rest", F.length(_last_line(F.col("part"))))
    # columns count from the last mark that had a line break in its text
    rows = (rows.withColumn("to_line", 1 + F.sum("breaks").over(so_far))
            .withColumn("run", F.sum((F.col("breaks") > 0).cast("int")).over(so_far)))
    in_run = Window.partitionBy(*FILE_KEY, "run").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("to_col", F.sum("rest").over(in_run))
    step = F.when(F.col("mark").isin(*_OPENS), 1).when(F.col("mark").isin(*_CLOSES), -1).otherwise(0)
    rows = (rows.withColumn("line", F.coalesce(F.lag("to_line").over(in_file), F.lit(1)))
            .withColumn("col", F.coalesce(F.lag("to_col").over(in_file), F.lit(0)))
            .withColumn("depth", F.coalesce(F.sum(step).over(before), F.lit(0)))
            .withColumn("prev", F.coalesce(F.lag("mark").over(in_file), F.lit("")))
            .withColumn("next_before", F.lead("before").over(in_file))
            .withColumn("next_mark", F.lead("mark").over(in_file)))
    # where the mark stands, and where the text before it ends (line and col: where that text begins)
    return (rows.withColumn("at", _after(F.col("line"), F.col("col"), F.col("before")))
            .withColumn("tail", _after(F.col("line"), F.col("col"), _trimmed(F.col("before"))))
            .drop("part", "breaks", "rest", "to_line", "to_col", "run"))


def linked(rows: DataFrame) -> DataFrame:
    """Marks with their partners: ``close`` of an opening bracket, the next block
    (``brace``, ``blank_brace`` with nothing before it) at its depth, and the next
    marks that end an expression or a statement there."""
    is_open, is_close = F.col("mark").isin(*_OPENS), F.col("mark").isin(*_CLOSES)
    rows = rows.withColumn("level", F.col("depth") + F.when(is_close, 0).otherwise(1))
    level = Window.partitionBy(*FILE_KEY, "level").orderBy("i")
    back = Window.partitionBy(*FILE_KEY, "level").orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, -1)
    brackets = is_open | is_close
    partner = F.lead(F.when(brackets, F.struct("i", "at", "next_before", "next_mark", "mark"))).over(level)
    rows = rows.withColumn("close", F.when(is_open & partner["mark"].isin(*_CLOSES), partner))
    brace = F.struct(F.col("i").alias("i"), F.col("before").alias("before"), F.col("close.at").alias("end"))
    rows = (rows.withColumn("brace", F.last(F.when(F.col("mark") == "{", brace), True).over(back))
            .withColumn("blank_brace", F.last(F.when((F.col("mark") == "{") & F.col("before").rlike(r"^\s*+$")
                                                     & F.col("prev").isin(")", "}"), brace), True).over(back)))
    depth = Window.partitionBy(*FILE_KEY, "depth").orderBy(F.desc("i"))
    later, now = (depth.rowsBetween(Window.unboundedPreceding, k) for k in (-1, 0))
    stop = F.col("mark").isin(*_STOPS, "") | is_close
    source = F.regexp_extract("before", r"(?:^\s*+import\s*+|\bfrom\s*+)(" + LITERAL + "+)", 1)
    lead = F.regexp_extract("before", r"^(?s)(.*?(?:^\s*+import\s*+|\bfrom\s*+))" + LITERAL, 1)
    rows = (rows.withColumn("ends", F.last(F.when(stop | (F.col("mark") == ","), F.col("tail")), True).over(later))
            .withColumn("stop", F.last(F.when(stop, F.struct("i", "at")), True).over(now))
            .withColumn("source", F.last(F.when(source != "", F.struct(
                "i", _after(F.col("line"), F.col("col"), lead).alias("at"), F.length(source).alias("n"))), True).over(now)))
    ahead = Window.partitionBy(*FILE_KEY, "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    fresh = F.col("prev").isin("", "\n", ";", "{", "}", "(")
    heads = F.when(fresh, F.col("before").rlike(r"^\s*+(?:export\s+)?(?:const|let|var)\b"))
    return rows.withColumn("declaring", F.coalesce(F.last(heads, True).over(
        ahead.rowsBetween(Window.unboundedPreceding, 0)), F.lit(False)))


def _found(kind: str, name: Column | None, pos: Column, end: Column, listed: bool = False) -> Column:
    """An entity; ``listed``: its parameters (or its name, a pattern) stand in the brackets here."""
    none = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (none.cast("string") if name is None else name).alias("name"),
                    pos.cast("long").alias("pos"), end.cast("long").alias("end_pos"),
                    (F.col("at") if listed else none.cast("long")).alias("args"),
                    (F.col("close.at") if listed else none.cast("long")).alias("args_end"))


def _behind(pattern: str, text: Column | None = None) -> Column:
    """Place where the match of ``pattern`` at the end of the text before begins."""
    text = F.col("before") if text is None else text
    cut = F.length(text) - F.length(F.regexp_extract(text, pattern, 0))
    return _after(F.col("line"), F.col("col"), F.substring(text, F.lit(1), cut))


def definitions(rows: DataFrame) -> DataFrame:
    """Marks with ``found``: the functions, arrows, declarators and classes that are
    recognised at them."""
    before, lang = F.col("before"), F.col("language")
    js, java, cpp = (lang == x for x in ("JavaScript", "Java", "C++"))
    paren = (F.col("mark") == "(") & F.col("close").isNotNull()
    rest, then = F.col("close.next_before"), F.col("close.next_mark")
    plain, block_next = rest.rlike(r"^\s*+$"), then == "{"
    far = F.lit((1 << 62) - 1)  # a block that is never closed reaches to the end of the file
    end = F.coalesce(F.col("brace.end") + 1, far)
    head = _after(F.col("line"), F.col("col"), F.regexp_extract("before", r"^\s*+", 0))

    function = F.regexp_extract(before, _JS_FUNCTION, 1)
    method = F.regexp_extract(before, _JS_METHOD, 1)
    js_body = block_next & rest.rlike(r"(?s)^\s*+(?::[^=]*+)?$")
    js_found = (F.when(paren & js_body & (function != ""), _found("function", function, _behind(_JS_FUNCTION), end, True))
                .when(paren & js_body & F.col("prev").isin("", "\n", ";", "{", "}", ",") & (method != ""),
                      _found("function", method, head, end, True)))
    # arrows: '(' whose list is followed by one, or '=>' after a lone name
    arrow_list = paren & (then == "=>") & rest.rlike(r"(?s)^\s*+(?::.*)?$")
    lone = r"(?<![\w$.])(?:async\s+)?" + _ID + r"\s*+$"
    arrow_name = (F.col("mark") == "=>") & (F.col("prev") != ")") & before.rlike(lone) & (F.length(F.trim(before)) > 0)
    body_at = F.when(arrow_list, F.col("close.i") + 2).otherwise(F.col("i") + 1)
    is_block = (F.col("brace.i") == body_at) & F.col("brace.before").rlike(r"^\s*+$")
    arrow_end = F.when(is_block, end).otherwise(F.coalesce(F.col("ends"), far))
    asynchronous = r"(?<![\w$.])async\s*+$"
    js_found = (js_found.when(arrow_list, _found("arrow", None, F.when(
        before.rlike(asynchronous), _behind(asynchronous)).otherwise(F.col("at")), arrow_end, True))
        .when(arrow_name, _found("arrow", None, _behind(lone), arrow_end)))
    # declarators, for the names of the arrows inside them
    declared = F.regexp_extract(before, _DECLARED, 1)
    following = F.when((F.col("prev") == ",") & F.col("declaring"), F.regexp_extract(before, _DECLARED_NEXT, 1))
    destructured = (F.col("mark").isin("{", "[") & before.rlike(r"(?:^|[^\w$.])(?:const|let|var)\s*+$")
                    & F.col("close.next_before").rlike(r"^\s*+(?::[^=]*+)?=(?![=>])"))
    declares = F.when(declared != "", declared).when(F.coalesce(following, F.lit("")) != "", following)
    ends = F.coalesce(F.col("ends"), far)
    named_at = _after(F.col("line"), F.col("col"), F.regexp_extract(
        before, r"(?s)^(?:.*[^\w$.])?(?:const|let|var)\s+|^\s*+", 0))
    declarator = (F.when(js & declares.isNotNull() & ~F.col("mark").isin(*_STOPS, ","),
                         _found("declarator", declares, named_at, ends))
                  .when(js & destructured, _found("declarator", None, F.col("at"), ends, True)))

    java_method = F.regexp_extract(before, _JAVA_METHOD, 1)
    constructor = F.when(F.col("prev").isin("", ";", "{", "}", ")"), F.regexp_extract(before, _JAVA_CONSTRUCTOR, 1))
    throws = rest.rlike(r"^\s*+throws\b")
    java_name = F.when(java_method != "", java_method).when(block_next | throws, constructor)
    past_notes = _after(F.col("line"), F.col("col"), F.regexp_extract("before", r"^\s*+(?:@[\w.]+\s++)*+", 0))
    java_end = F.when(block_next & plain | throws & (F.col("stop.i") > F.col("brace.i")), end).when(
        (then == ";") & plain | throws, F.col("stop.at") + 1)
    java_found = F.when(paren & (F.coalesce(java_name, F.lit("")) != "") & (plain & then.isin("{", ";") | throws),
                        _found("function", java_name, past_notes, java_end, True))

    cpp_lead = F.when((F.col("prev") == ",") & before.rlike(_CPP_COMMA), F.regexp_extract(before, _CPP_COMMA, 0)).otherwise(
        F.regexp_extract(before, _CPP_LEAD, 0))
    cpp_text = F.substring(before, F.length(cpp_lead) + 1, F.length(before))
    cpp_name = F.regexp_replace(F.regexp_extract(cpp_text, _CPP_FUNCTION, 1), r"\s+(?=\W)|(?<=~)\s+", "")
    statement = F.col("prev").isin("", ";", "{", "}") | (F.col("prev") == ",") & before.rlike(_CPP_COMMA)
    listed = rest.rlike(r"(?s)^(?:\s|const\b|noexcept\b)*+:(?!:)") | rest.rlike(r"\bnoexcept\s*+$") & (then == "(")
    cpp_end = (F.when(listed, F.coalesce(F.col("blank_brace.end") + 1, far))
               .when(block_next & rest.rlike(_CPP_TAIL), end)
               .when((then == ";") & rest.rlike(r"^(?:\s|const\b|noexcept\b)*+=\s*+(?:default|delete)\s*+$"), F.col("stop.at") + 1))
    cpp_found = F.when(paren & statement & (cpp_name != "") & cpp_end.isNotNull(), _found(
        "function", cpp_name, _after(F.col("line"), F.col("col"), cpp_lead), cpp_end, True))

    function_found = F.when(js, js_found).when(java, java_found).when(cpp, cpp_found)
    none = F.lit(None).cast("struct<kind:string,name:string,pos:long,end_pos:long,args:long,args_end:long>")
    class_found = none
    for name, rule in _CLASS.items():
        word = F.regexp_extract(before, rule, 1)
        prefix = F.substring(before, F.lit(1), F.locate("class", before) - 1) if name != "C++" else F.regexp_extract(
            before, r"(?s)^(.*)(?<!\w)(?:class|struct)\s", 1)
        fits = (lang == name) & (word != "") & ~F.col("mark").isin(";", ")")
        if name == "C++":
            fits = fits & F.col("mark").isin("{", ",")
        if name == "Java":
            fits = fits & (F.col("mark") != "(")
        own = F.when(F.col("mark") == "{", F.col("close.at")).otherwise(F.col("brace.end"))
        pos = _after(F.col("line"), F.col("col"), prefix) if name != "Java" else past_notes
        class_found = F.when(fits, _found("class", F.regexp_extract(before, rule, 2), pos, F.coalesce(own + 1, far))).otherwise(
            class_found)
    rows = rows.withColumn("found", F.filter(F.array(function_found, declarator, class_found), lambda x: x.isNotNull()))
    # the entries of a constructor's list are no calls
    listing = F.when(cpp & listed & F.exists("found", lambda x: x["kind"] == "function"), True).when(
        (F.col("mark") == ";") | (F.col("mark") == "{") & before.rlike(r"^\s*+$"), False)
    ahead = Window.partitionBy(*FILE_KEY, "depth").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("in_list", F.coalesce(F.last(listing, True).over(ahead), F.lit(False))).withColumn(
        "declared", cpp & paren & statement & cpp_text.rlike(_CPP_DECLARED))


def calls(rows: DataFrame, not_callees: list[str], not_callees_java: list[str]) -> Column:
    """Callee at a '(' mark, null where it is none."""
    before, java = F.col("before"), F.col("language") == "Java"
    name = F.regexp_replace(F.regexp_extract(before, _CALL, 2), r"\s+", "")
    callee = F.element_at(F.split(name, r"\."), -1)
    note = java & before.rlike(r"@[\w$.]+\s*+$")
    defined = F.exists("found", lambda x: (x["kind"] == "function"))
    return F.when((F.col("mark") == "(") & (callee != "") & (F.regexp_extract(before, _CALL, 1) == "") & ~note & ~defined
                  & ~F.col("in_list") & ~F.coalesce("declared", F.lit(False)) & (name.contains(".") | ~(
                      callee.isin(*not_callees) | java & callee.isin(*not_callees_java))), callee)


def bracket_entities(files: DataFrame, not_callees: list[str], not_callees_java: list[str]) -> DataFrame:
    """Marks that hold an entity, a call or an import, with what they hold."""
    masked = files.select(*FILE_KEY, "language", F.size(split_lines(F.col("content"))).alias("n_lines"),
                          mask_in_place(F.col("content"), F.col("language")).alias("masked"))
    rows = definitions(linked(marks(masked)))
    before, lang = F.col("before"), F.col("language")
    js_import = ((lang == "JavaScript") & before.rlike(r"^\s*+import\b(?!\s*+\.)") & F.col("prev").isin("", "\n", ";", "{", "}")
                 & ~((F.col("mark") == "(") & before.rlike(r"^\s*+import\s*+$")))
    java_import = (lang == "Java") & before.rlike(r"^\s*+import\s") & (F.col("mark") == ";")
    head = _after(F.col("line"), F.col("col"), F.regexp_extract("before", r"^\s*+", 0))
    java_module = F.regexp_extract(before, r"^\s*+import\s+(?:static\s+)?([\w$]+(?:\.[\w$]+)+)", 1)
    module = F.when(java_import, F.when(java_module != "", java_module).otherwise(F.concat(py_strip(before), F.lit(";"))))
    imported = F.when(js_import | java_import, F.struct(head.alias("pos"), module.alias("module"), F.when(
        js_import & (F.col("source.i") <= F.col("stop.i")), F.col("source")).alias("source")))
    rows = rows.withColumn("callee", calls(rows, not_callees, not_callees_java)).withColumn("imported", imported)
    return (rows.where((F.size("found") > 0) | F.col("callee").isNotNull() | F.col("imported").isNotNull())
            .select(*FILE_KEY, "language", "n_lines", "at", "found", "callee", "imported"))


def _column(place: Column) -> Column:
    return (place % LINE).cast("int")


def _listed_lines(found: DataFrame) -> DataFrame:
    """``FILE_KEY, args, line``: the lines of the brackets that parameters stand in."""
    return found.where("args is not null").select(
        *FILE_KEY, "args", F.explode(F.sequence(_line_of(F.col("args")), _line_of(F.col("args_end")))).alias("line"))


def _imported_lines(rows: DataFrame) -> DataFrame:
    """The imports among the marks with the ``line`` their module is read from."""
    found = rows.where(F.col("imported").isNotNull()).select(*FILE_KEY, "language", "imported.*")
    return found.withColumn("line", F.coalesce(_line_of(F.col("source.at")), _line_of(F.col("pos"))))


def lines_read(rows: DataFrame) -> DataFrame:
    """``FILE_KEY, line``: the lines that ``named_entities`` and ``source_modules`` read."""
    found = rows.select(*FILE_KEY, F.explode("found").alias("f")).select(*FILE_KEY, "f.args", "f.args_end")
    return _listed_lines(found).select(*FILE_KEY, "line").unionByName(_imported_lines(rows).select(*FILE_KEY, "line"))


def named_entities(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``FILE_KEY, language, kind, name, parameters, pos, end_pos, line, end_line``
    of functions and classes: parameter lists as the original lines have them, arrows
    under the name of the innermost declarator around them (without one they have
    none and are left out)."""
    found = rows.select(*FILE_KEY, "language", "n_lines", F.explode("found").alias("f")).select(
        *FILE_KEY, "language", "n_lines", "f.*")
    wanted = _listed_lines(found).distinct()
    texts = (lines.select(*FILE_KEY, "line", "text").join(wanted, FILE_KEY + ["line"]).groupBy(*FILE_KEY, "args")
             .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda x: x["text"]),
                               "\n").alias("text")))
    found = found.join(texts, FILE_KEY + ["args"], "left")
    first = _column(F.col("args"))
    listed = split_arguments(F.substring("text", first + 2, F.length("text")), F.col("language").isin("Java", "C++"))
    beyond = F.length(F.substring_index("text", "\n", -1)) - _column(F.col("args_end")) - 1
    pattern = F.substring("text", first + 1, F.length("text") - first - beyond)
    found = found.withColumn("parameters", F.when(F.col("kind").isin("function", "arrow"), F.coalesce(
        F.when(F.col("args").isNotNull(), listed), F.array().cast("array<string>")))).withColumn(
        "name", F.when((F.col("kind") == "declarator") & F.col("name").isNull(), pattern).otherwise(F.col("name")))
    declarators, arrows = (found.where(F.col("kind") == k) for k in ("declarator", "arrow"))
    inside = innermost_enclosing(
        declarators.select(*FILE_KEY, F.col("pos").alias("range_id"), F.col("pos").alias("line"),
                           (F.col("end_pos") - 1).alias("end_line")),
        arrows.select(*FILE_KEY, F.col("pos").alias("point_id"), F.col("pos").alias("line")))
    names = declarators.select(*FILE_KEY, F.col("pos").alias("range_id"), F.col("name").alias("declared"))
    arrows = (arrows.join(inside.where("range_id is not null").select(*FILE_KEY, F.col("point_id").alias("pos"), "range_id"),
                          FILE_KEY + ["pos"]).join(names, FILE_KEY + ["range_id"])
              .withColumn("name", F.col("declared")).withColumn("kind", F.lit("function")).select(found.columns))
    return found.where(F.col("kind").isin("function", "class")).unionByName(arrows).select(
        *FILE_KEY, "language", "kind", "name", "parameters", "pos", "end_pos", _line_of(F.col("pos")).alias("line"),
        F.least(_line_of(F.col("end_pos")), F.col("n_lines")).alias("end_line"))


def source_modules(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """C4 of JavaScript and Java: ``FILE_KEY, language, module, pos``; a module that
    is a literal is read from its line, an import without one gives its line."""
    found = _imported_lines(rows)
    text = F.substring(F.col("text"), _column(F.col("source.at")) + 1, F.col("source.n"))
    module = F.coalesce("module", F.nullif(strip_chars(text, "\"'"), F.lit("")), py_strip(F.col("text")))
    return (found.join(lines.select(*FILE_KEY, "line", "text"), FILE_KEY + ["line"], "left")
            .select(*FILE_KEY, "language", module.alias("module"), "pos"))
