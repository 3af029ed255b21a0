"""Problem 3: template residue, filler, error pages and please-enable-scripts notices.

Texts are cut into messages (lines outside code; of long lines also the sentences and
elements). Numbers, addresses and dates are masked, and equal normalised messages are
grouped by hash with the number of sources (skills and reports) they stand in. Each
distinct message is classified once, by phrase and placeholder rules, a message that is
only likely residue (a bare status phrase, say) only if it recurs across sources. What is
classified as residue is joined back to its sources by hash.

Defined results: null, empty or merely short texts are no cases; anything in fenced or
inline code is left out, as is quoted speech; repeated rows of a key count once, the one
loaded last; null entries of invocations are skipped; texts of any length are read
whole: lines too long for the rules of whole lines are also judged by sentence and HTML
element; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomline.runtime import cut, latest

# Reason phrases of HTTP, filler vocabulary, words for scripts.
REASONS = (
    "Bad Request|Unauthori[sz]ed|Payment Required|Forbidden|Not Found|Method Not Allowed|Not Acceptable|Request Time-?out|Conflict|Gone|"
    "Precondition Failed|Payload Too Large|Too Many Requests|Internal Server Error|Not Implemented|Bad Gateway|Service (?:Temporarily )?Unavailable|Gateway Time-?out"
)
FILLER = (
    "lorem|ipsum|dolor|dolore|dolores|sit|amet|consectetur|adipiscing|elit|sed|eiusmod|tempor|incididunt|labore|magna|aliqua|enim|minim|veniam|quis|"
    "nostrud|exercitation|ullamco|laboris|laborum|nisi|aliquip|commodo|consequat|duis|aute|irure|reprehenderit|voluptate|velit|esse|cillum|fugiat|nulla|"
    "pariatur|excepteur|sint|occaecat|cupidatat|proident|culpa|officia|deserunt|mollit|anim|est|justo|vitae|sapien|mauris|viverra|tellus|pulvinar|ut|et|ad|id|in|non"
)
SCRIPTS = r"(?:java-?script|js|scripting|scripts?|cookies)"

_NAME = r"[A-Za-z][\w .\-]{0,40}"
#: Unfilled slots anywhere in a line of prose.
SLOT_PROSE = "|".join(
    (
        r"\{\{-?\s*[#/^&>]?\s*[\w.\-]+(?:\s*\|[^{}\n]{0,60})?\s*-?\}\}",
        r"\{%-?\s*\w+[^%\n]{0,80}%\}",
        r"<%[=\-]?\s*[\w.@]+[^%\n]{0,40}%>",
        r"[$#]\{\s*[\w.]+\s*\}",
        r"(?<![\w$#@{])\{[A-Za-z_][\w .\-]{0,40}\}(?!\})",
        r"%%[A-Za-z]\w*%%|@@[A-Za-z]\w*@@|(?<![\w])__[A-Z][A-Z0-9_]*__(?!\w)",
        r"(?<![\w$])%[A-Z][A-Z_]{2,}%",
        r"<(?i:your|insert|enter|add)[ _\-]" + _NAME + r">",
        r"\[(?i:your|insert|enter|add|placeholder)[ _:\-]" + _NAME + r"\](?!\()",
        r"\[\[\s*[A-Za-z]\w*\s*\]\]",
        r"<!--\s*" + _NAME + r"\s(?i:goes here|here|tbd|placeholder)\s*-->",
        r"\bYOUR_[A-Z][A-Z_]*\b|(?i:\bpath/to/your/)",
    )
)
#: Slots in a command; braces and dollars of shells and languages are no slots.
SLOT_COMMAND = "|".join(
    (
        r"\{\{\s*[\w.\-]+(?:\s*\|[^{}\n]{0,60})?\s*\}\}",
        r"\{%-?\s*\w+[^%\n]{0,80}%\}|<%[=\-]?\s*[\w.@]+[^%\n]{0,40}%>",
        r"(?<![\w$#@{%'\"(])\{[A-Za-z_][\w\-]{1,40}\}(?![\}\w])|(?<=[/:=])\{[A-Za-z_][\w\-]{1,40}\}",
        r"%%[A-Za-z]\w*%%|@@[A-Za-z]\w*@@|(?<![\w./])__[A-Z][A-Z0-9_]*__(?![\w.])",
        r"<[A-Za-z][a-z]*(?:[_\- ][A-Za-z]+){0,4}>(?!\s*[\w./-]+\.\w+\s*>)",
        r"\[(?i:your|insert|enter)[ _\-]" + _NAME + r"\]|\[\[\s*[A-Za-z]\w*\s*\]\]",
        r"\bYOUR_[A-Z][A-Z_]*\b|(?i:\bpath/to/your/)",
        r"(?<=\s)(?:TODO|FIXME|TBD|CHANGEME|REPLACE_ME)\s*$",
    )
)
#: Values that were never resolved.
UNRESOLVED = "|".join(
    (
        r"\[object Object\]|\bInvalid Date\b|\bNone@None\b|\bNone None\b|\bundefined undefined\b|\bnull null\b|\bNaN%|\$NaN\b",
        r"(?i:\b(?:welcome to|hello|hi|dear|version|made by|written by|created by|maintained by|published by|author:|name:|contact:|maintainer:|owner:))\s+(?:undefined|UNDEFINED|null|NULL|NaN|NAN|None|NONE|nil)\b(?!\s+(?:or|and|values?|means|is|as)\b)",
        r"(?i:\bfor\s+nan\s+users\b)",
    )
)
UNRESOLVED_COMMAND = r"\[object Object\]|\bInvalid Date\b|--?[\w-]+[ =](?:undefined|NaN|null|None)(?=\s|$)"
#: Text that is still to be written, as a whole line.
UNWRITTEN = (
    r"(?iu)^\W*(?:(?:TODO|FIXME|TBD|TBA|XXX)\b\s*(?:[:.\-]\s*.*|(?:write|add|describe|fill|document|explain|complete|finish|insert)\b.*)?"
    r"|to be (?:written|supplied|added|determined|announced|completed|done)\W*|.{0,60}\bto be (?:supplied|written|added|completed)\W*"
    r"|.{0,40}\bcoming soon\W*|.{0,60}\bgoes here\W*|write (?:one or two|a few|some|a|your) (?:\w+ ){0,3}(?:sentences?|text|description|summary|paragraph)\b.*\bhere\W*"
    r"|\(?(?:add|insert|put|enter|place) (?:a|an|your|some|the)? ?(?:\w+ ){0,6}here\W*|replace this (?:text|line|section|paragraph)\b.*|(?:your|placeholder) (?:text|description|content)(?: here)?\W*"
    r"|(?:asdf|qwerty|xxx+|blah|foo|test|abc)(?:\s+(?:asdf|qwerty|xxx+|blah|foo|test|abc)){1,}\W*|(?:(?:sample|dummy|placeholder|example) text\W*){2,}"
    r"|this (?:section|page|text|document) (?:is|has been) (?:left blank|intentionally blank|empty|a placeholder|under construction)\W*|under construction\W*)$"
)
LATIN_FILLER = rf"(?i)\blorem ipsum dolor\b|(?:\b(?:{FILLER})\b[\s,.;]*){{5,}}"
#: Error pages, as a whole line.
ERROR_LINE = "|".join(
    (
        rf"^\W*(?:HTTP(?:/[\d.]+)?\s+)?(?:Error\s*)?:?\s*[45]\d\d\s*[|:.\-–]?\s*(?:{REASONS})\b.{{0,120}}$",
        rf"^\W*(?:{REASONS})\s*[|:(\-–]?\s*[45]\d\d\W*$",
        r'^\W*\{\s*"?error"?\s*:\s*\{\s*"?(?:code|status|message)"?\s*:.{0,300}$|^\W*\{\s*"?(?:status|code)"?\s*:\s*[45]\d\d\b.{0,300}$',
        rf"^\s*(?:<[^>]*>\s*)*(?:[45]\d\d\s*)?(?:{REASONS})\s*(?:<[^>]*>\s*)+.{{0,200}}$",
        r"^\W*(?:error|fehler|erreur|errore|erro|fout|ошибка|błąd|エラー|错误)\s*[:#]?\s*[45]\d\d\b.{0,100}$",
        r"^.{0,60}\((?:error|fehler|erreur|errore|erro|fout|ошибка)\s*[45]\d\d\)\W*$|^.{0,80}\b(?:code d'erreur|error code|fehlercode|código de error)\s*:?\s*[45]\d\d\W*$",
        r"^\W*(?:the requested (?:url|page|resource)\b.{0,40}\b(?:was not found|could not be found|does not exist)\b.{0,60}|(?:sorry, )?we (?:could ?n[o']t|can ?n[o']t) find (?:the|that) page\b.{0,60})$",
        r"^\W*(?:oops!?\s*)?something went wrong\W{0,3}(?:\s*please\b.{0,40})?$|^\W*(?:the server (?:met|encountered) an (?:unexpected|internal)\b.{0,80})$",
        r"^\W*(?:access (?:to this \w+ )?(?:is |has been )?denied\b\W*(?:you do(?: not|n't) have permission\b.{0,80})?|you do(?: not|n't) have permission to (?:view|access)\b.{0,80})$",
        r"^\W*[45]\d\d\W*$",
        r"^\W*(?:session (?:has )?expired\b.{0,80}|.{0,40}\bunavailable: (?:this|the) (?:content|page|repository)\b.{0,80}|this (?:content|page) (?:has been|was) (?:removed|deleted)\b.{0,60})$",
        r"^\W*rate limit exceeded\b.{0,60}$",
        r"^\W*(?:just a moment\W*|checking your browser\b.{0,60}|verify (?:that )?you are (?:a )?human\b.{0,80}|please wait while we (?:verify|check)\b.{0,60})$",
    )
)
#: Notices that scripts are needed: a line about scripts, a need and a page at once.
_NEED = r"(?:enabled?|enabling|disabled|turn(?:ed)?[\w ]{0,6} (?:on|off)|switch(?:ed)?[\w ]{0,6} (?:on|off)|activ\w*|aktivier\w*|need(?:s|ed)?|requires?|required|support|besoin|necesita|requiere|precisa|richiede|vereist|нужен|включите)"
_PAGE = r"(?:this (?:page|site|app|application|website|content|check)|your browser|this app\b|to continue|to view|to run|the page|diese seite|ce site|cette page|esta p[áa]gina|questa pagina|deze pagina|if nothing happens|страниц\w*)"
SCRIPT_LINE = rf"^(?=.{{0,200}}$)(?=.*\b{SCRIPTS}\b)(?=.*\b{_NEED}\b)(?=.*\b{_PAGE}).*$"
#: Bare phrases that are residue only where they recur.
LIKELY_LINE = rf"^\W*(?:{REASONS})\W*$"

#: Lines above this are also judged in parts, cut between sentences and at the tags of HTML blocks.
LONG_LINE = 140
_INLINE = r"(?:a|abbr|b|br|code|em|font|i|kbd|q|s|small|span|strong|sub|sup|u)\b"
SENTENCES = r" (?<=[.!?] )|(?<=。)"
ELEMENTS = SENTENCES + rf"|(?=<(?!(?i:{_INLINE}))[A-Za-z])|(?<=</(?!(?i:{_INLINE}))[A-Za-z][A-Za-z0-9]{{0,14}}>)"

_ZERO_WIDTH = "\u00ad\u034f\u180e\u200b\u200c\u200d\u200e\u200f\u2060\u2061\u2062\u2063\ufeff"
_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u00a0\u2007\u2009\u202f\u3000"
_NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "     "


def _steps(rows: DataFrame, column: str, *steps: tuple[Callable[[Column], Column], Callable[[Column], Column]]) -> DataFrame:
    """rows with each (needs, change) applied to column in turn where needs holds."""
    c = F.col(column)
    for needs, change in steps:
        rows = rows.withColumn(column, F.when(needs(c), change(c)).otherwise(c))
    return rows


def _has(*words: str) -> Callable[[Column], Column]:
    """Whether one of the words stands in a text: a plain search, far cheaper than a pattern."""
    return lambda c: reduce(lambda x, y: x | y, [F.contains(c, F.lit(w)) for w in words])


def _gone(pattern: str, mark: str) -> Callable[[Column], Column]:
    return lambda c: F.regexp_replace(c, pattern, mark)


#: Full-width forms as ordinary ones, without invisible characters, lines ended by LF.
PLAIN = (
    (_has("\r"), _gone("\r\n?", "\n")),
    (lambda c: c.rlike(r"[^\x00-\x7f]"), lambda c: F.translate(c, _WIDE + _ZERO_WIDTH, _NARROW)),
)
#: Without fenced blocks and inline code.
NO_CODE = (
    (_has("```", "~~~"), _gone(r"(?sm)^[ \t>]*(?:```|~~~).*?(?:^[ \t>]*(?:```|~~~)[ \t]*$|\z)", "\n")),
    (_has("`"), _gone(r"(`+)[^`\n]+\1", " ")),
)
#: Numbers, addresses, dates and ids masked; status codes stay, since rules read them.
MASKS = (
    (_has("://"), _gone(r"(?i)\b(?:https?|ftp)://[^\s{}<>\[\]\"']+", "\u27e8url\u27e9")),
    (_has("@"), _gone(r"[\w.+-]+@[\w-]+\.[\w.-]+", "\u27e8mail\u27e9")),
    (lambda c: c.rlike(r"\d{4}-\d"), _gone(r"\b\d{4}-\d\d-\d\d(?:[T ]\d\d:\d\d(?::\d\d)?)?", "\u27e8date\u27e9")),
    (lambda c: c.rlike(r"\d[A-Fa-f]|[A-Fa-f]\d"), _gone(r"(?i)\b(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{6,}\b", "\u27e8id\u27e9")),
    (lambda c: c.rlike(r"\d"), _gone(r"\b(?![45]\d\d\b)\d+(?:\.\d+)*\b", "0")),
    (lambda c: c.rlike(r"\s\s|[^\S ]"), _gone(r"\s+", " ")),
)


def _quotes_out(line: Column) -> Column:
    return F.regexp_replace(line, "\"[^\"]{1,200}\"|\u201c[^\u201d]{1,200}\u201d|\u00ab[^\u00bb]{1,200}\u00bb|\u201e[^\u201c\u201d]{1,200}[\u201c\u201d]", " ")


#: Words of which a message of each rule holds one, in lower case.
_HINTS = {
    "unresolved": ("object object", "invalid date", "undefined", "null", "nan", "none", "nil"),
    "scripts": ("script", "js", "cookies"),
    "unwritten": ("todo", "fixme", "tbd", "tba", "xxx", "to be ", "coming soon", "here", "replace this", "text", "description", "content", "asdf", "qwerty", "blah", "foo", "test", "abc", "blank", "empty", "a placeholder", "under construction"),
    "filler": ("lorem", "dolor", "amet", "consectetur", "adipiscing", "veniam", "nostrud", "laboris", "cillum", "pariatur", "proident", "deserunt", "ullamco", "aliquip", "viverra"),
    "error": ("error", "\u043e\u0448\u0438\u0431\u043a\u0430", "wrong", "found", "find", "denied", "permission", "expired", "unavailable", "removed", "deleted", "limit", "moment", "checking", "human", "wait", "unexpected", "<h", "<center", "not exist"),
    "slot": ("path/to", "your_"),
    "command slot": ("path/to", "your_", "todo", "fixme", "tbd", "changeme", "replace"),
}


def verdict(line: Column, low: Column, said: Column, part: Column, command: Column) -> Column:
    """The rule a masked message falls under, null if none. Each rule has a cheap necessary condition before it.

    low: line in lower case; part: whether it is a part of a long line; those rules that search within a line judge the line alone.
    For parts letters of any script are letters, so that a sentence that only holds a number is no status code.
    """
    whole = ~part
    hint = lambda name: _has(*_HINTS[name])(low)
    short = F.length(line) <= 420
    either = lambda of_command, of_prose: (command & line.rlike(of_command)) | (~command & line.rlike(of_prose))
    rule = F.when(F.length(line) == 0, F.lit(None).cast("string"))
    rule = rule.when(short & (line.rlike(r"[45]\d\d") | hint("error")) & F.when(part, line.rlike("(?iU)" + ERROR_LINE)).otherwise(line.rlike("(?iu)" + ERROR_LINE)), "error page")
    rule = rule.when(whole & (line.rlike(r"[{<\[%@_]") | F.when(command, hint("command slot")).otherwise(hint("slot"))) & either(SLOT_COMMAND, SLOT_PROSE), "unfilled slot")
    rule = rule.when(whole & hint("unresolved") & either(UNRESOLVED_COMMAND, UNRESOLVED), "unresolved value")
    rule = rule.when(hint("scripts") & (F.length(said) <= 200) & said.rlike(rf"(?iu)\b{SCRIPTS}\b") & said.rlike("(?iu)" + SCRIPT_LINE), "scripts needed")
    rule = rule.when(~command & (F.length(line) <= 140) & hint("unwritten") & F.when(part, line.rlike("(?U)" + UNWRITTEN)).otherwise(line.rlike(UNWRITTEN)), "unwritten")
    rule = rule.when(~command & whole & hint("filler") & said.rlike(r"(?i)\b(?:lorem|dolor|amet|consectetur|adipiscing|veniam|nostrud|laboris|cillum|pariatur|proident|deserunt|ullamco|aliquip|viverra)\b") & said.rlike(LATIN_FILLER), "filler")
    return rule.when(whole & (F.length(line) <= 60) & line.rlike("(?iu)" + LIKELY_LINE), "likely error page")


def _parts(line: Column, said: Column) -> Column:
    """The message and, if it is long, its sentences and elements; of a long JSON object the head."""
    one = lambda p, q, part: F.struct(p.alias("line"), F.lower(p).alias("low"), q.alias("said"), F.lit(part).alias("part"))
    part = lambda p: one(p, p, True)
    head = F.when(F.startswith(line, F.lit("{")), F.array(part(F.left(line, F.lit(300))))).otherwise(F.array().cast("array<struct<line:string,low:string,said:string,part:boolean>>"))
    cut_up = F.transform(F.filter(F.transform(F.when(F.contains(said, F.lit("<")), F.split(said, ELEMENTS)).otherwise(F.split(said, SENTENCES)), F.btrim), lambda x: x != ""), part)
    whole = F.array(one(line, said, False))
    return F.when(F.length(line) > LONG_LINE, F.concat(whole, head, cut_up)).otherwise(whole)


def _with_said(rows: DataFrame) -> DataFrame:
    """said: the line without quoted speech."""
    return rows.withColumn("said", F.when(F.col("line").rlike("[\"\u201c\u201e\u00ab]"), _quotes_out(F.col("line"))).otherwise(F.col("line")))


def _lines(rows: DataFrame) -> DataFrame:
    """(record_kind, record_id, h, line) of the normalised lines of (record_kind, record_id, text): h is the hash of kind and line."""
    split = rows.select("record_kind", "record_id", F.explode(F.array_distinct(F.split("text", r"\n"))).alias("line"))
    masked = _steps(split.filter(F.length(F.btrim("line")) > 0), "line", *MASKS)
    return masked.select("record_kind", "record_id", F.xxhash64("record_kind", F.btrim("line")).alias("h"), F.btrim("line").alias("line"))


def sources(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """(record_kind, record_id, h, line): the normalised lines of every body and invocation, written once."""
    body = latest(skills.select(F.col("skill_id").cast("bigint").alias("record_id"), "body", "loaded_at"), ["record_id"], "body").filter(F.length("body") > 0)
    calls = latest(reports.select(F.col("report_id").cast("bigint").alias("record_id"), "invocations", "loaded_at"), ["record_id"], "invocations")
    calls = calls.select("record_id", F.explode("invocations").alias("text")).filter(F.length("text") > 0)
    texts = _steps(body.select("record_id", F.col("body").alias("text")), "text", *PLAIN, *NO_CODE)
    both = texts.select(F.lit("skill").alias("record_kind"), "record_id", "text").unionByName(_steps(calls, "text", *PLAIN).select(F.lit("report").alias("record_kind"), "record_id", "text"))
    return cut(_lines(both))


def classified(lines: DataFrame, single: bool = False) -> DataFrame:
    """(h, record_kind, line, rule): the distinct normalised messages that are residue, each classified once; a long one by each of its parts.

    A message that is only likely residue counts where it recurs across sources; single: also where it stands in one.
    """
    groups = lines.groupBy("h", "record_kind", "line").agg((F.min("record_id") < F.max("record_id")).alias("recurs"))
    # The generators keep each part and each verdict an attribute that is computed once.
    parts = _with_said(groups).select("h", "record_kind", F.col("line").alias("message"), "recurs", F.explode(_parts(F.col("line"), F.col("said"))).alias("m"))
    rule = verdict(F.col("m.line"), F.col("m.low"), F.col("m.said"), F.col("m.part"), F.col("record_kind") == "report")
    judged = parts.select("h", "record_kind", "message", "recurs", F.explode(F.array_compact(F.array(rule))).alias("rule"))
    sure = judged.filter((F.col("rule") != "likely error page") | F.col("recurs") | F.lit(single))
    return sure.select("h", "record_kind", F.col("message").alias("line"), "rule")


def messages(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """(message, rule, records): every message that is residue, or likely so, with the number of records it stands in."""
    lines = sources(skills, reports)
    found = lines.select("record_id", "h").join(classified(lines, single=True).distinct(), "h").select("record_kind", "record_id", "line", "rule").distinct()
    return found.groupBy(F.col("line").alias("message"), "rule").agg(F.count("*").alias("records"))


def residue(skills: DataFrame, reports: DataFrame) -> DataFrame:
    """(record_kind, record_id) of the skills and reports to leave out."""
    lines = sources(skills, reports)
    return lines.select("record_kind", "record_id", "h").join(classified(lines).select("h").distinct(), "h", "left_semi").select("record_kind", "record_id").distinct()
