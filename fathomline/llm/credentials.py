"""Problem 1: credentials in code and configuration, by a linear-chain CRF.

Lines are cut into lexical tokens. A conditional random field with shape and context
features labels each token as other, name of a credential, joint between name and value,
or secret; it is trained here on lines drawn from a grammar. The Viterbi spans of secrets
are the characters that get masked. An exact check afterwards drops what no one can use:
placeholders, masked values and test-mode keys.

Defined results: null and empty texts hold none; repeated rows of a key count once, the
one loaded last; lines are split at LF, a CR stays part of its line's white space; texts
and lines of any length are read whole; a line counts once however many credentials it
holds; extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomline.llm.credential_lines import TEST_VENDORS, VENDORS, Lines
from fathomline.runtime import latest

LABELS = "okps"
#: Bounds of training: lines drawn, passes over them, seed.
TRAIN_LINES, EPOCHS, SEED = 9_000, 10, 11

_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<pem>-----BEGIN[ ][A-Z0-9 ]{0,40}PRIVATE[ ]KEY(?:[ ]BLOCK)?-----)
    |(?P<block>-----(?:BEGIN|END)[ ][A-Z0-9 ]{1,60}-----)
    |(?P<escape>\\[nrt])
    |(?P<ref>\$\{|\$\(|\{\{|<%|%\()
    |(?P<scheme>[A-Za-z][A-Za-z0-9+.]{1,20}://)
    |(?P<joined>(?<=\s)-p(?=[^\s\-=]))
    |(?P<flag>(?<![\w\-])--?[A-Za-z][A-Za-z0-9_\-]*)
    |(?P<chunk>[^\s"'`()\[\]{}<>,;=:@|\\]+(?:={1,2}(?=["'`\s,;)]|$))?)
    |(?P<sign>.)""",
    re.X | re.S,
)
_SUB = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\d_]+")
_VENDOR = re.compile("^(?:" + "|".join(sorted((re.escape(v[0]) for v in VENDORS), key=len, reverse=True)) + r")(?=[A-Za-z0-9_\-]{6})")
_TESTKEY = re.compile("^(?:" + "|".join(map(re.escape, (*TEST_VENDORS, "pk_live_"))) + ")")
_HOLDER = re.compile(
    r"(?i)example|change[_-]?me|replace[_-]?(?:me|this|with)|placeholder|^your|your[_-]|insert[_-]|redacted|dummy|x{4,}|^todo$|fill[_-]?in|not[_-]a[_-]real|goes[_-]here|^none$|^null$|^(?:secret|password|token|test|sample|undefined|true|false)$|\*{3,}|\.{3}|sample[_-]"
)
_PATH = re.compile(r"^[.~]{0,2}/|/.+/|\.(?:csv|json|txt|ya?ml|md|py|js|sh|lst|xml|html?|css|svg|zip|ini|toml|log|po|tsv|xlsx|db|ods|rst|pem|crt)$")
_HEX = re.compile(r"^[0-9a-f]{16,}$")
_UUID = re.compile(r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}$")


def lex(line: str) -> list[tuple[str, str, int]]:
    """(kind, text, start) of each token that is not white space."""
    return [(m.lastgroup, m.group(), m.start()) for m in _TOKEN.finditer(line) if m.lastgroup != "space"]


@lru_cache(100_000)
def subwords(text: str) -> tuple[str, ...]:
    return tuple(w.lower() for w in _SUB.findall(text)[:8])


def value_shape(t: str) -> list[str]:
    n = len(t)
    has = ("l" if re.search("[a-z]", t) else "") + ("u" if re.search("[A-Z]", t) else "") + ("d" if re.search(r"\d", t) else "") + ("s" if re.search(r"[!#$^*?%~]", t) else "") + ("j" if re.search(r"[_\-./+]", t) else "")
    size = next(str(b) for b in (3, 5, 7, 9, 11, 15, 19, 23, 27, 31, 39, 63, 10**9) if n <= b)
    squeezed = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\W\d_a-z]", "A", re.sub("[a-z]", "a", re.sub(r"\d", "0", t))))[:6]
    out = [f"cls={has}", f"size={size}", f"cs={has}/{size}", f"sq={squeezed}"]
    if len(has) == 1:
        out.append("uniform")
    v = _VENDOR.match(t)
    if _TESTKEY.match(t):
        out.append("testkey")
    elif v:
        out += ["vendor", f"v={v.group()}", f"vs={size}"]
    if n >= 6 and len(set(t.lower())) < 5:
        out.append("flat")
    for name, rx in (("holder", _HOLDER), ("path", _PATH), ("hex", _HEX), ("uuid", _UUID)):
        if rx.search(t):
            out.append(name)
    if t.startswith("&") or t.startswith("$"):
        out.append("start=" + t[0])
    if t.startswith("/"):
        out.append("start=/")
    if t.endswith("="):
        out.append("pad")
    changes = sum(a.isdigit() != b.isdigit() for a, b in zip(t, t[1:]))
    out.append(f"mix={min(changes, 6)}")
    vowels = sum(c in "aeiouyAEIOUY" for c in t)
    letters = sum(c.isalpha() for c in t)
    if letters >= 5:
        out.append(f"vow={round(4 * vowels / letters)}")
    return out


@lru_cache(100_000)
def own(kind: str, t: str) -> tuple[str, ...]:
    """Features of a token by itself."""
    if kind in ("sign", "escape", "ref", "pem", "block", "joined"):
        return ("t=" + (t if kind in ("sign", "ref") else kind),)
    out = [f"kind={kind}"]
    subs = subwords(t)
    if kind == "scheme":
        return tuple(out)
    out += [f"sub={s}" for s in subs if len(s) < 16]
    if subs:
        out.append(f"last={subs[-1]}")
    if len(t) <= 24:
        out.append(f"w={t.lower()}")
    return tuple(out + value_shape(t))


@lru_cache(100_000)
def brief(kind: str, t: str) -> tuple[str, ...]:
    """What neighbours see of a token."""
    if kind in ("sign", "ref"):
        return (t,)
    if kind in ("escape", "pem", "block", "joined", "scheme"):
        return (kind,)
    subs = subwords(t)
    return (kind, "s:" + subs[-1] if subs and len(t) <= 32 else "long", *(["has:" + s for s in subs] if len(t) <= 32 else ()))


def naming(kind: str, t: str) -> tuple[str, ...]:
    """What a token says as the name before a value; nothing if it cannot be one."""
    return tuple(f"n={s}" for s in subwords(t)[-3:]) if kind in ("chunk", "flag") and len(t) <= 40 else ()


def above(tokens: list[tuple[str, str, int]], before: str) -> tuple[str, ...]:
    """The name on the line above a line that only holds a value."""
    if any(t == "value" for _, t, _ in tokens[:3]) and "name" in before:
        return tuple(s for _, t, _ in lex(before)[-3:] for s in subwords(t))
    return ()


def alone(tokens: list[tuple[str, str, int]]) -> bool:
    return len(tokens) <= 2 and sum(k == "chunk" for k, _, _ in tokens) == 1


def described(line: str, before: str) -> tuple[list[tuple[str, str, int]], list[list[tuple[str, tuple[str, ...]]]]]:
    """Tokens and, for each, its feature groups: (role, features). What training sees; tagging reads the same sums from tables."""
    tokens = lex(line)
    rows = []
    named: tuple[str, ...] = ()
    edge = ("edge",)
    upper, lone = above(tokens, before), alone(tokens)
    for i, (kind, t, _) in enumerate(tokens):
        groups = [("0", own(kind, t)), ("key", named)]
        for role, k in (("-1", i - 1), ("-2", i - 2), ("+1", i + 1), ("+2", i + 2)):
            groups.append((role, brief(*tokens[k][:2]) if 0 <= k < len(tokens) else edge))
        if upper:
            groups.append(("above", upper))
        if lone:
            groups.append(("lone", own(kind, t)[-12:]))
        rows.append(groups)
        named = naming(kind, t) or named
    return tokens, rows


#: The roles in which a token's features are seen: by itself, by its neighbours, as the name before a value, alone on its line.
_ROLES = ("0", "-1", "-2", "+1", "+2", "key", "lone")
_PATHS_AT_ONCE = 400_000


class Tagger:
    """Feature weights and label transitions. Tokens recur from line to line, so each has a number and its scores in every role a row."""

    def __init__(self, weights: dict[str, np.ndarray], moves: np.ndarray, first: np.ndarray):
        self.weights, self.moves, self.first = weights, moves, first
        self._forget()

    def __getstate__(self):
        return {"weights": self.weights, "moves": self.moves, "first": self.first}

    def __setstate__(self, state: dict):
        self.__init__(**state)

    def _forget(self) -> None:
        self._numbers: dict[tuple[str, str], int] = {}
        self._table = np.zeros((4096, len(_ROLES), len(LABELS)))
        self._namer = np.zeros(4096, bool)
        # Row 0 stands for the line's edge.
        for role in (1, 2, 3, 4):
            self._table[0, role] = self._sum(_ROLES[role], ("edge",))

    def _sum(self, role: str, features: tuple[str, ...]) -> np.ndarray:
        total = np.zeros(len(LABELS))
        for f in features:
            w = self.weights.get(role + "|" + f)
            if w is not None:
                total = total + w
        return total

    def _number(self, kind: str, text: str) -> int:
        n = len(self._numbers) + 1
        if n == len(self._table):
            self._table = np.concatenate([self._table, np.zeros_like(self._table)])
            self._namer = np.concatenate([self._namer, np.zeros_like(self._namer)])
        mine, seen = own(kind, text), brief(kind, text)
        for k, role in enumerate(_ROLES[:5]):
            self._table[n, k] = self._sum(role, seen if k else mine)
        names = naming(kind, text)
        self._table[n, 5], self._namer[n] = self._sum("key", names), bool(names)
        self._table[n, 6] = self._sum("lone", mine[-12:])
        self._numbers[(kind, text)] = n
        return n

    def labels(self, line: str, before: str = "") -> tuple[list[tuple[str, str, int]], str]:
        """The tokens of a line and their most probable labels."""
        return self.tagged([(line, before)])[0]

    def tagged(self, lines: list[tuple[str, str]]) -> list[tuple[list[tuple[str, str, int]], str]]:
        """labels() of many (line, line before)."""
        if len(self._numbers) > 300_000:
            self._forget()
        known = self._numbers
        told = [lex(line) for line, _ in lines]
        ids = np.array([known.get(t[:2]) or self._number(*t[:2]) for tokens in told for t in tokens], np.int64)
        sizes = np.array([len(tokens) for tokens in told], np.int64)
        scores = self._scores(ids, sizes, [alone(tokens) for tokens in told])
        begins = np.concatenate([[0], np.cumsum(sizes)])
        for k, ((_, before), tokens) in enumerate(zip(lines, told)):
            if before and (extra := above(tokens, before)):
                scores[begins[k] : begins[k + 1]] += self._sum("above", extra)
        paths = self._paths(scores, begins)
        return [(tokens, paths[begins[k] : begins[k + 1]]) for k, tokens in enumerate(told)]

    def _scores(self, ids: np.ndarray, sizes: np.ndarray, lone: list[bool]) -> np.ndarray:
        """The score of every label at every token of consecutive lines."""
        n = len(ids)
        line = np.repeat(np.arange(len(sizes)), sizes)
        pad = np.concatenate([[0, 0], ids, [0, 0]])
        whose = np.concatenate([[-1, -1], line, [-1, -1]])
        total = self._table[ids, 0]
        for role, shift in ((1, -1), (2, -2), (3, 1), (4, 2)):
            at = np.arange(2, n + 2) + shift
            total = total + self._table[np.where(whose[at] == line, pad[at], 0), role]
        # The name before a token is the last token before it on its line that can be one.
        place = np.where(self._namer[ids], np.arange(n), -1)
        last = np.concatenate([[-1], np.maximum.accumulate(place)[:-1]]) if n else place
        named = (last >= 0) & (line[np.maximum(last, 0)] == line)
        total = total + np.where(named[:, None], self._table[ids[np.maximum(last, 0)], 5], 0)
        return total + np.where(np.array(lone, bool)[line][:, None], self._table[ids, 6], 0)

    def _paths(self, scores: np.ndarray, begins: np.ndarray) -> str:
        """The most probable label sequences of all lines (Viterbi), lines of like length together; joined up."""
        sizes = np.diff(begins)
        out = np.zeros(len(scores), np.int64)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            longest = sizes[order[at : at + 4096]]
            take = max(1, min(len(longest), int((np.arange(1, len(longest) + 1) * longest <= _PATHS_AT_ONCE).sum())))
            some = order[at : at + take]
            at += take
            size, start = sizes[some], begins[some]
            best = self.first + scores[start]
            came = np.zeros((int(size.max()), len(some), len(LABELS)), np.int8)
            for t in range(1, int(size.max())):
                live = t < size
                x = best[:, :, None] + self.moves
                came[t] = x.argmax(1)
                step = x.max(1) + scores[np.minimum(start + t, len(scores) - 1)]
                best = np.where(live[:, None], step, best)
            y = best.argmax(1)
            rows = np.arange(len(some))
            for t in range(int(size.max()) - 1, -1, -1):
                live = t < size
                out[(start + t)[live]] = y[live]
                y = np.where(live, came[t, rows, y], y)
        return "".join(np.array(list(LABELS))[out].tolist())


def _examples(count: int, seed: int) -> tuple[list, list]:
    g = Lines(seed)
    feats, gold = [], []
    for _ in range(count):
        text, marks, before = g.draw()
        tokens, rows = described(text, before)
        if not tokens:
            continue
        y = []
        for _, t, at in tokens:
            part = marks[at : at + len(t)]
            y.append(max(LABELS, key=lambda c: (part.count(c), -LABELS.index(c))))
        feats.append([[r + "|" + f for r, fs in groups for f in fs] for groups in rows])
        gold.append([LABELS.index(c) for c in y])
    return feats, gold


def train(count: int = TRAIN_LINES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.12, decay: float = 2e-5) -> Tagger:
    """Maximise the lines' conditional likelihood by AdaGrad with batched forward-backward."""
    feats, gold = _examples(count, seed)
    seen: dict[str, int] = {}
    for line in feats:
        for token in line:
            for f in token:
                seen[f] = seen.get(f, 0) + 1
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 2))}
    n, L = len(index), len(LABELS)
    W, M, S = np.zeros((n, L)), np.zeros((L, L)), np.zeros(L)
    gw, gm, gs = (np.full(x.shape, 1e-6) for x in (W, M, S))
    ids = [[np.array([index[f] for f in token if f in index], np.int64) for token in line] for line in feats]
    order = sorted(range(len(ids)), key=lambda i: len(ids[i]))
    batches = [order[i : i + 64] for i in range(0, len(order), 64)]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for b in rng.permutation(len(batches)):
            lines = batches[b]
            T = max(len(ids[i]) for i in lines)
            B = len(lines)
            flat = np.concatenate([t for i in lines for t in ids[i]])
            counts = [len(t) for i in lines for t in ids[i]]
            owner = np.repeat(np.array([k * T + j for k, i in enumerate(lines) for j in range(len(ids[i]))]), counts)
            rows = W[flat]
            E = np.stack([np.bincount(owner, rows[:, y], B * T) for y in range(L)], 1).reshape(B, T, L)
            size = np.array([len(ids[i]) for i in lines])
            live = np.arange(T)[None] < size[:, None]
            A, Z = np.zeros((B, T, L)), np.zeros((B, T, L))
            A[:, 0] = S + E[:, 0]
            for t in range(1, T):
                x = A[:, t - 1, :, None] + M
                top = x.max(1)
                A[:, t] = np.where(live[:, t, None], top + np.log(np.exp(x - top[:, None]).sum(1)) + E[:, t], A[:, t - 1])
            for t in range(T - 2, -1, -1):
                x = M + (E[:, t + 1] + Z[:, t + 1])[:, None]
                top = x.max(2)
                Z[:, t] = np.where(live[:, t + 1, None], top + np.log(np.exp(x - top[..., None]).sum(2)), 0)
            end = A[:, -1]
            logz = end.max(1) + np.log(np.exp(end - end.max(1, keepdims=True)).sum(1))
            P = np.exp(A + Z - logz[:, None, None]) * live[..., None]
            grad = P.copy()
            gM, gS = np.zeros((L, L)), P[:, 0].sum(0)
            for t in range(1, T):
                q = np.exp(A[:, t - 1, :, None] + M + (E[:, t] + Z[:, t])[:, None] - logz[:, None, None]) * live[:, t, None, None]
                gM += q.sum(0)
            for k, i in enumerate(lines):
                y = gold[i]
                grad[k, np.arange(len(y)), y] -= 1
                gS[y[0]] -= 1
                np.subtract.at(gM, (y[:-1], y[1:]), 1)
            back = grad.reshape(B * T, L)[owner]
            gW = np.stack([np.bincount(flat, back[:, y], n) for y in range(L)], 1)
            for x, g, h in ((W, gW, gw), (M, gM, gm), (S, gS, gs)):
                g = g / B + decay * x
                h += g * g
                x -= rate * g / np.sqrt(h)
    return Tagger({f: W[i] for f, i in index.items() if np.abs(W[i]).max() > 1e-3}, M, S)


@lru_cache(1)
def tagger() -> Tagger:
    """The tagger with production parameters, trained once per process."""
    return train()


_FENCE = re.compile(r"-----(BEGIN|END) [A-Z0-9 ]{1,60}-----")


def usable(value: str) -> bool:
    """Whether a literal can be a working credential: no placeholder, mask, reference or test-mode key."""
    v = value.strip("-_*.")
    if len(v) < 4 or len(set(v.lower())) < 4 or _TESTKEY.match(value) or _HOLDER.search(value):
        return False
    if value.startswith("$") and value[1:2].isalpha() and value[1:].replace("_", "").isalnum() and value[1:].isupper():
        return False
    digits = re.sub(r"^[A-Za-z]{2,12}[_\-]", "", value)
    return not re.fullmatch(r"(.)\1{7,}", digits)


def _spans(tokens: list[tuple[str, str, int]], marks: str, inside: bool) -> list[tuple[int, int]]:
    if "s" not in marks:
        return []
    if inside and len(tokens) == 1 and tokens[0][0] == "chunk" and not _VENDOR.match(tokens[0][1]):
        return []  # the body of a key block or certificate; only its header line counts
    out: list[list[tuple[int, int, str, str]]] = []
    for i, ((kind, t, at), y) in enumerate(zip(tokens, marks)):
        if y != "s" or kind not in ("chunk", "pem", "flag"):
            continue
        back = i - 1
        while back >= 0 and marks[back] == "p":
            back -= 1
        # Pieces that are only joined to each other are one value.
        if out and out[-1][-1][0] == back and back >= 0 and marks[back] == "s":
            out[-1].append((i, at, t, kind))
        else:
            out.append([(i, at, t, kind)])
    found = []
    for pieces in out:
        if pieces[0][3] == "pem" or usable("".join(p[2] for p in pieces)):
            found += [(at + t.rfind("：") + 1, at + len(t)) for _, at, t, _ in pieces]  # a wide colon does not end a token
    return found


def spans(line: str, before: str, model: Tagger, inside: bool = False) -> list[tuple[int, int]]:
    """Start and end of each literal to mask in the line. inside: whether it lies within a key block or certificate."""
    return _spans(*model.labels(line, before), inside)


def _above(line: str, before: str) -> str:
    """The line before, where the features of this one look at it."""
    return before if "value" in line and "name" in before else ""


#: Distinct lines tagged at a time.
LINES_AT_ONCE = 20_000


def scan_texts(texts: list[str], model: Tagger) -> list[list[tuple[int, list[tuple[int, int]]]]]:
    """For each text (line number from 1, spans) of the lines that hold a credential. Equal lines are tagged once."""
    lined = [text.split("\n") for text in texts]
    distinct = list(dict.fromkeys((line, _above(line, before)) for lines in lined for before, line in zip(["", *lines], lines) if line))
    told: dict = {}
    for k in range(0, len(distinct), LINES_AT_ONCE):
        some = distinct[k : k + LINES_AT_ONCE]
        told.update((key, t) for key, t in zip(some, model.tagged(some)) if "s" in t[1])
    out = []
    for lines in lined:
        found, before, inside = [], "", False
        for k, line in enumerate(lines, 1):
            t = told.get((line, _above(line, before)))
            if t and (s := _spans(*t, inside)):
                found.append((k, s))
            before = line
            if "-----" in line:
                for m in _FENCE.finditer(line):
                    inside = m[1] == "BEGIN"
        out.append(found)
    return out


def scan_text(text: str, model: Tagger) -> list[tuple[int, list[tuple[int, int]]]]:
    """(line number from 1, spans) of the lines of one text that hold a credential."""
    return scan_texts([text], model)[0]


_HEAD = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_TAIL = re.compile(r"-----END [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----")
_RUN = re.compile(r"[A-Za-z0-9+/=]+")
_ESCAPED = re.compile(r"(\\[nrt])")
#: A line that is nothing but key material, with what may stand around it: comment or quote marks before, a line end and joining marks behind.
_BODY_LINE = re.compile(r"^([ \t>#*|/]*)([A-Za-z0-9+/=]+)((?:\\[nrt])*[ \t\r]*)$")
_LITERAL = re.compile(r"\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`")


def _starred(text: str) -> str:
    """Every run of key characters as stars; escapes stay."""
    return "".join(part if k % 2 else _RUN.sub(lambda m: "*" * len(m.group()), part) for k, part in enumerate(_ESCAPED.split(text)))


def _masked_body(body: str, closed: bool) -> str:
    """What follows a key block's header: to its end mark, or, without one, as far as lines are nothing but key material.

    On the header's own line the key runs on up to a quote or blank; on later lines whole lines of key material and, within a closed block, quoted pieces.
    """
    lines = body.split("\n")
    run = re.match(r"(?:\\[nrt]|[A-Za-z0-9+/=])*", lines[0]).end()
    lines[0] = _starred(lines[0][:run]) + lines[0][run:]
    if not closed and lines[0][run:].strip(" \t\r\"'`,;+\\()"):
        return "\n".join(lines)  # the header is only named in a line of code
    for k, line in enumerate(lines[1:], 1):
        m = _BODY_LINE.match(line)
        if m and (closed or len(m[2]) >= 16 or k > 1):
            lines[k] = m[1] + "*" * len(m[2]) + m[3]
            continue
        pieces = [] if m else [x for x in _LITERAL.finditer(line) if x.group()[1:-1] and re.fullmatch(r"(?:\\[nrt]|[A-Za-z0-9+/=])+", x.group()[1:-1])]
        if pieces and (closed or len(pieces[0].group()) >= 18):
            lines[k] = _LITERAL.sub(lambda x: x.group()[0] + _starred(x.group()[1:-1]) + x.group()[-1] if re.fullmatch(r"(?:\\[nrt]|[A-Za-z0-9+/=])+", x.group()[1:-1]) else x.group(), line)
        elif not closed:
            break
    return "\n".join(lines)


def redact(text: str, found: list[tuple[int, list[tuple[int, int]]]]) -> str:
    """text with each span masked character by character; bodies of key blocks are masked, nothing else moves."""
    lines = text.split("\n")
    for k, marked in found:
        line = lines[k - 1]
        for a, b in marked:
            if not line[a:b].startswith("-----BEGIN"):
                line = line[:a] + "*" * (b - a) + line[b:]
        lines[k - 1] = line
    out, at, done = "\n".join(lines), 0, []
    while head := _HEAD.search(out, at):
        nxt = _HEAD.search(out, head.end())
        limit = nxt.start() if nxt else len(out)
        tail = _TAIL.search(out, head.end(), limit)
        end = tail.start() if tail else limit
        done += [out[at : head.end()], _masked_body(out[head.end() : end], tail is not None)]
        at = end
    return "".join(done) + out[at:]


_FOUND = "record_kind string, record_id bigint, line_no bigint, span_starts array<int>, span_ends array<int>"


def _scanner(model: Tagger):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            # The source of a finding is one line, whatever ends it holds.
            lined = [t.replace("\n", " ") if kind == "finding" else t for kind, t in zip(batch["record_kind"], batch["text"])]
            for kind, i, found in zip(batch["record_kind"], batch["record_id"], scan_texts(lined, model)):
                rows += [(kind, i, k, [a for a, _ in s], [b for _, b in s]) for k, s in found]
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "line_no", "span_starts", "span_ends"])

    return run


def _redactor(model: Tagger):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for kind, i, text, found in zip(batch["record_kind"], batch["record_id"], batch["text"], scan_texts(list(batch["text"]), model)):
                if found:
                    rows.append((kind, i, redact(text, found), sum(len(s) for _, s in found)))
            yield pd.DataFrame(rows, columns=["record_kind", "record_id", "redacted", "places"])

    return run


def texts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, text) of files and of the sources of findings."""
    a = latest(files.select(F.col("file_id").cast("bigint").alias("record_id"), "file_text", "loaded_at"), ["record_id"], "file_text")
    b = latest(findings.select(F.col("finding_id").cast("bigint").alias("record_id"), "source", F.col("found_at").alias("loaded_at")), ["record_id"], "source")
    both = a.select(F.lit("bundled_file").alias("record_kind"), "record_id", F.col("file_text").alias("text")).unionByName(b.select(F.lit("finding").alias("record_kind"), "record_id", F.col("source").alias("text")))
    return both.filter(F.length("text") > 0)


def credential_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, line_no, span_starts, span_ends): each line with a usable credential and where it stands."""
    return texts(files, findings).mapInPandas(_scanner(tagger()), _FOUND)


def redacted_texts(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(record_kind, record_id, redacted, places): the texts that hold credentials, with them masked."""
    return texts(files, findings).mapInPandas(_redactor(tagger()), "record_kind string, record_id bigint, redacted string, places int")
