"""Column functions for text, paths and match positions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends besides LF at which text editors and Python split.
_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once, however often use refers to it."""
    return F.transform(F.array(value), use)[0]


def text_of(content: Column) -> Column:
    """UTF-8 text of bytes, broken sequences replaced, line ends as LF."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), "\r\n?", "\n")


def stripped(c: Column) -> Column:
    """Text without outer Unicode white space."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def split_lines(c: Column) -> Column:
    """Lines at every Unicode line end, without an empty one after the last."""
    return let(F.split(c, _ENDS, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    """Everything before the last slash; the slash itself for files at the root, empty where there is none."""
    head = F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)
    return F.when(F.instr(path, "/") == 0, "").when(F.regexp_replace(head, "/", "") == "", F.concat(head, F.lit("/"))).otherwise(F.rtrim(head, F.lit("/")))


def suffix(name: Column) -> Column:
    """The last .x of a file name, empty for names that only begin with a dot."""
    return F.regexp_extract(name, r"(?s)^.+(\.[^.]+)$", 1)


def normal_path(path: Column) -> Column:
    """An absolute path with . and .. resolved; .. above the root stays at the root."""
    parts = F.aggregate(
        F.split(path, "/"),
        F.array().cast("array<string>"),
        lambda done, p: F.when((p == "") | (p == "."), done).when(p == "..", F.when(F.size(done) > 0, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.array_append(done, p)),
    )
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def any_contains(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether one of the constant words stands in the text."""
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(c, w))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<hit, line, tail>> of a pattern's matches: the text, its line from 1, and what stands before it back to the match before.

    The pattern must not match the empty text. Line numbers come from a copy of the text in
    which each match is a mark, cut into lines, so the work grows with the text alone.
    """
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.split(text, pattern, -1)
    whole = hits if group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    mark = "\x00"

    def placed(z: Column) -> Column:
        h, g, w = z["h"], z["g"], z["w"]
        # Each match becomes its line ends and a mark before them; marks per line give the lines of the matches in order.
        pieces = F.transform(h, lambda _, k: F.concat(F.replace(F.get(g, k), F.lit(mark), F.lit("")), F.lit(mark), F.regexp_replace(F.get(w, k), "[^\n]", "")))
        marked = F.split(F.array_join(pieces, ""), "\n", -1)
        lines = F.flatten(F.transform(marked, lambda line, k: F.array_repeat(k + 1, F.size(F.split(line, mark, -1)) - 1)))
        # The text before a match, back to the match before it: enough for looking back, never a copy of the whole prefix.
        tail = lambda k: F.concat(F.when(k > 0, F.get(w, k - 1)).otherwise(""), F.get(g, k))
        return let(lines, lambda at: F.transform(h, lambda x, k: F.struct(x.alias("hit"), F.get(at, k).cast("int").alias("line"), tail(k).alias("tail"))))

    none = F.array().cast("array<struct<hit:string,line:int,tail:string>>")
    return let(F.struct(hits.alias("h"), gaps.alias("g"), whole.alias("w")), lambda z: F.when(F.size(z["h"]) > 0, placed(z)).otherwise(none))
