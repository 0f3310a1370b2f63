"""Personal data: fixed patterns, extended by a skip-chain conditional random field.

Nodes are the mentions of a document: base spans and other runs that look like a number or an
address. Neighbouring mentions share chain potentials; distant mentions that repeat or resemble one
another share skip potentials. Loopy message passing makes the labels of one entity agree across
the whole document, so that a number written another way is found with the one that a pattern knows.

All potentials are learned by pseudo-likelihood from the table itself. Base spans have their kind as
label and other mentions none, but for those linked to a base span, whose label is open. What
links are worth is learned from base spans written another way: each copy is an example of its kind
beside the span, and of no kind without it.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
# The base patterns. Look-behinds and possessive runs change no match: where a run's
# first character begins none, no other of it does.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
NEXT_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-]){EMAIL.pattern}")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: What may be a mention besides base spans: numbers, and addresses with their sign or a word for it.
MENTION = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,3}[0-9])+|(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|[\x20]?[(\[]at[)\]][\x20]?)[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*")
AT = re.compile(r"[\x20]?[(\[]at[)\]][\x20]?")
DIGITS = re.compile(r"[^0-9]")
#: How two mentions are alike: the same digits or address; the same last seven digits, or name before
#: the sign; one digit of ten or more differs.
SAME, TAIL, NEAR = range(3)


def luhn(digits: str) -> bool:
    """Whether the check digit fits: every second digit from the right counts double."""
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, pos = [], 0
    while "@" in text and (m := EMAIL.match(text, pos) or NEXT_EMAIL.search(text, pos)):
        out.append(m.span())
        pos = m.end()
    return out


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in IP.finditer(text) if all(map(_byte, m.group().split(".")))]


def _cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in CARD.finditer(text) if m.end() - m.start() >= 16 and 16 <= len(d := DIGITS.sub("", m.group())) <= 19 and luhn(d)]


def _phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in PHONE.finditer(text) if 8 <= len(DIGITS.sub("", m.group())) <= 15]


FINDERS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of all base spans, by kind and then start."""
    return [(k, s, e) for k, kind in enumerate(KINDS) for s, e in FINDERS[kind](text)]


def form(mention: str) -> str:
    """What makes two mentions the same: an address in lower case, or a number's digits."""
    return AT.sub("@", mention).lower() if "@" in mention or AT.search(mention) else DIGITS.sub("", mention)


def features(text: str, start: int, end: int) -> tuple[str, ...]:
    """A node's features, each of a few values: what it is made of, and whether it stands apart.

    Numbers of digits up to 19, five ways to part them, a plus sign, a fitting check digit, what is beside it.
    """
    m = text[start:end]
    beside = f"b{int(text[start - 1 : start].isalnum() or text[end : end + 1].isalnum())}"
    if "@" in m or AT.search(m):
        return ("@" if "@" in m else "(at)", beside)
    digits = DIGITS.sub("", m)
    n = min(len(digits), 20)
    marks = {c for c in m if not c.isdigit() and c != "+"}
    parted = "none" if not marks else "mixed" if len(marks) > 1 else "space" if marks == {" "} else "dot" if marks == {"."} else "dash" if marks == {"-"} else "mixed"
    groups = f"g{min(len(re.findall('[0-9]+', m)), 6)}"
    fits = f"l{int(n >= 16 and luhn(digits[:40]))}"
    plus = f"p{int(m[0] == '+')}"
    return (f"n{n}", parted, fits, plus, beside, groups, f"n{n}{fits}", f"n{n}{plus}", f"{parted}{groups}")


def mentions(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int | None]]:
    """Nodes (start, end, label) in text order: base spans, labelled, then runs that meet none of them."""
    taken = sorted((s, e, k + 1) for k, s, e in base)
    out: list[tuple[int, int, int | None]] = list(taken)
    i, reach = 0, 0
    for m in MENTION.finditer(text):
        s, e = m.span()
        while i < len(taken) and taken[i][0] < e:  # base spans of two kinds may overlap
            reach = max(reach, taken[i][1])
            i += 1
        if reach > s:
            continue
        if m.group()[0] not in "+(0123456789" or "@" in m.group() or AT.search(m.group()) or 6 <= len(DIGITS.sub("", m.group())) <= 19:
            out.append((s, e, None))
    return sorted(out, key=lambda x: (x[0], x[1]))


def has_mentions(text: str) -> bool:
    return "@" in text or "at)" in text or "at]" in text or bool(re.search(r"[0-9]", text))


def skips(forms: list[str]) -> dict[tuple[int, int], int]:
    """(i, j) -> how they are alike, i before j: each node and the one before it that has one of its keys.

    Keys stand for the three ways to be alike, so that links grow with mentions and not with pairs.
    """
    last: dict[tuple, int] = {}
    out: dict[tuple[int, int], int] = {}
    for j, f in enumerate(forms):
        keys = [(SAME, f)]
        if "@" in f:
            keys.append((TAIL, f.partition("@")[0]))
        else:
            keys += [(TAIL, f[-7:])] * (len(f) >= 7) + [(NEAR, i, f[:i] + "?" + f[i + 1 :]) for i in range(len(f) if 10 <= len(f) <= 19 else 0)]
        for key in keys:
            i = last.get(key)
            if i is not None:
                out[i, j] = min(out.get((i, j), NEAR), key[0])
            last[key] = j
    return out


class Field:
    """Log potentials: ``node`` by feature (labels), ``chain`` by the labels of neighbours, ``skip`` by likeness and both labels."""

    def __init__(self, node: dict[str, np.ndarray], chain: np.ndarray, skip: np.ndarray):
        self.node, self.chain, self.skip = node, chain, skip

    def unary(self, marks: tuple[str, ...]) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for f in marks:
            if f in self.node:
                out = out + self.node[f]
        return out

    def marginals(self, unary: np.ndarray, links: dict[tuple[int, int], int], fixed: list[int | None], rounds: int = 50) -> np.ndarray:
        """Beliefs by loopy sum-product, damped by a half; exact where the links close no loop."""
        n, states = unary.shape
        unary = unary.copy()
        for i, k in enumerate(fixed):
            if k is not None:
                unary[i] = -60.0
                unary[i, k] = 0.0
        pairs = [(i, i + 1, self.chain) for i in range(n - 1)] + [(i, j, self.skip[t]) for (i, j), t in links.items()]
        if not pairs:
            return _softmax(unary)
        a, b = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        table = np.array([p[2] for p in pairs])
        to_b, to_a = np.zeros((len(pairs), states)), np.zeros((len(pairs), states))
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            new_b = _log_sum(table + (belief[a] - to_a)[:, :, None], 1)
            new_a = _log_sum(table + (belief[b] - to_b)[:, None, :], 2)
            new_b -= new_b.max(1, keepdims=True)
            new_a -= new_a.max(1, keepdims=True)
            moved = max(np.abs(new_b - to_b).max(), np.abs(new_a - to_a).max())
            to_b, to_a = 0.5 * (to_b + new_b), 0.5 * (to_a + new_a)
            if moved < 1e-6:
                break
        belief = unary.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
        return _softmax(belief)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis)
    return top + np.log(np.exp(x - np.expand_dims(top, axis)).sum(axis))


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def rewritten(kind: int, mention: str) -> list[str]:
    """Other ways to write a base span that no base pattern finds."""
    if KINDS[kind] == "email":
        return [mention.replace("@", at) for at in (" (at) ", "(at)", " [at] ")]
    digits = DIGITS.sub("", mention)
    if KINDS[kind] == "ip":
        return [re.sub(r"\.", mark, mention) for mark in ("-", " ", " . ")]
    if KINDS[kind] == "card":
        groups = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        wrong = str((int(digits[7]) + 1) % 10)
        return [".".join(groups), digits[:7] + wrong + digits[8:], digits[:-3] + str((int(digits[-3]) + 1) % 10) + digits[-2:]]
    return [mention[1:], "0" + digits[2:], ".".join((digits[:3], digits[3:6], digits[6:])), "-".join((digits[:-7], digits[-7:-4], digits[-4:])), digits]


def _evidence(text: str) -> Iterator[tuple[str, str, str, str, int]]:
    """(features, label before, label after, link, label): what pseudo-likelihood counts, one document.

    A label that is open, or of no neighbour, is empty; of a node's links that to the nearest mention before
    or after it with a label counts.
    """
    nodes = mentions(text, base_spans(text))
    forms = [form(text[s:e]) for s, e, _ in nodes]
    links = skips(forms)
    known: list[int | None] = [k if k is not None else 0 for _, _, k in nodes]
    near: dict[int, list[tuple[int, int]]] = {}
    for (i, j), t in links.items():
        near.setdefault(i, []).append((j, t))
        near.setdefault(j, []).append((i, t))
    for i, others in near.items():
        if not nodes[i][2] and any(nodes[j][2] for j, _ in others):
            known[i] = None
    show = lambda k: "" if k is None else str(k)
    for i, (s, e, k) in enumerate(nodes):
        if known[i] is None:
            continue
        before, after = known[i - 1] if i else None, known[i + 1] if i + 1 < len(nodes) else None
        link = min(((abs(i - j), t, known[j]) for j, t in near.get(i, ()) if known[j] is not None), default=None)
        yield " ".join(features(text, s, e)), show(before), show(after), f"{link[1]}{link[2]}" if link else "", known[i]
        if not k or len(text[s:e]) > 200:
            continue
        for other in rewritten(k - 1, text[s:e]):
            marks, alike = " ".join(features(other, 0, len(other))), skips([forms[i], form(other)]).get((0, 1))
            if alike is not None:
                yield marks, "", "", f"{alike}{k}", k
                yield marks, "", "", f"{alike}0", 0
                yield marks, "", "", "", 0


def fit(docs: DataFrame, decay: float = 0.02, steps: int = 400) -> Field:
    """Learns the field from all documents of ``docs``.

    What a node's label is given its neighbours' is counted by Spark over the whole table; the driver
    gets one row for each combination of features and labels that occurs. Features have few values
    by their make (under 1,000 combinations), labels five and links fifteen, whatever the size of the
    table. The weights are the maximum of the log pseudo-likelihood (each document's mean, so that it
    doesn't depend on the table's size) less ``decay`` times half their squares.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for t in batch.column(0):
                if has_mentions(text := t.as_py()):
                    seen.update(_evidence(text))
        names = ["marks", "before", "after", "link", "label", "n"]
        rows = [(*k, n) for k, n in seen.items()]
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], names)

    keys = ["marks", "before", "after", "link", "label"]
    rows = docs.where("text is not null").select("text").mapInArrow(count, "marks string, before string, after string, link string, label long, n long").groupBy(*keys).agg(F.sum("n").alias("n")).collect()
    return learned(sorted((r.marks, r.before, r.after, r.link, r.label, r.n) for r in rows), decay, steps)


def learned(rows: list[tuple], decay: float, steps: int) -> Field:
    """The field of best pseudo-likelihood for counted ``rows``, by gradient steps with a memory of their size."""
    states = len(LABELS)
    names = sorted({f for r in rows for f in r[0].split()})
    if not rows:
        return Field({}, np.zeros((states, states)), np.zeros((3, states, states)))
    at = {f: i for i, f in enumerate(names)}
    x = np.zeros((len(rows), len(names)))
    for i, r in enumerate(rows):
        x[i, [at[f] for f in r[0].split()]] = 1.0
    label = np.array([r[4] for r in rows])
    weight = np.array([float(r[5]) for r in rows])
    # classes count alike: the few mentions of one kind are not outweighed by numbers of no kind
    for k in range(states):
        weight[label == k] /= max(1.0, weight[label == k].sum())
    one = np.eye(states)
    before, after = (np.array([one[int(r[c])] if r[c] else np.zeros(states) for r in rows]) for c in (1, 2))
    linked = np.zeros((len(rows), 3, states))
    for i, r in enumerate(rows):
        if r[3]:
            linked[i, int(r[3][0]), int(r[3][1:])] = 1.0
    node, chain, skip = np.zeros((len(names), states)), np.zeros((states, states)), np.zeros((3, states, states))
    memory = [np.full_like(v, 1e-8) for v in (node, chain, skip)]
    for _ in range(steps):
        score = x @ node + before @ chain + after @ chain.T + np.einsum("nts,tsk->nk", linked, skip)
        error = weight[:, None] * (one[label] - _softmax(score))
        grads = [x.T @ error, before.T @ error + error.T @ after, np.einsum("nts,nk->tsk", linked, error)]
        grads[2] = grads[2] + grads[2].transpose(0, 2, 1)  # alike either way round
        for v, g, m in zip((node, chain, skip), grads, memory, strict=True):
            g = g - decay * 0.1 * v
            m += g * g
            v += 0.3 * g / np.sqrt(m)
    return Field({f: node[i] for f, i in at.items()}, chain, skip)


def all_spans(text: str, field: Field, threshold: float = 0.9) -> tuple[list, list]:
    """(base spans, all spans): the field adds mentions whose belief in one kind exceeds ``threshold``.

    Base spans are given, every other mention's label is open, in every document that has mentions.
    """
    base = base_spans(text) if has_mentions(text) else []
    nodes = mentions(text, base) if has_mentions(text) else []
    if len(nodes) == len(base):
        return base, base
    unary = np.array([field.unary(features(text, s, e)) for s, e, _ in nodes])
    belief = field.marginals(unary, skips([form(text[s:e]) for s, e, _ in nodes]), [k for _, _, k in nodes])
    added = [(int(b.argmax()) - 1, s, e) for b, (s, e, k) in zip(belief, nodes, strict=True) if k is None and b.argmax() > 0 and b.max() > threshold]
    return base, sorted(base + added)


def _join(spans: list) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, base and all spans (arrays of kind, start, end), counts of base spans.

    Offsets are code points, ends exclusive. Null text is empty; null and repeated doc_ids keep their
    rows; other columns are ignored.
    """
    share = docs.sparkSession.sparkContext.broadcast(field)  # weights of some dozens of features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                base, every = all_spans(t.as_py() or "", share.value)
                n = Counter(k for k, _, _ in base)
                rows.append((doc_id, *(n[k] for k in range(4)), hashlib.sha256(_join(base).encode()).hexdigest(), _join(every)))
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field, mark: str = "<{}>") -> DataFrame:
    """``docs`` with every span of the text replaced by its kind.

    Of spans that overlap the first goes. Null texts stay null; all rows and columns stay.
    """
    share = docs.sparkSession.sparkContext.broadcast(field)
    cols = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = cols.index("text")
        for batch in batches:
            new = []
            for t in batch.column(at):
                text, out, pos = t.as_py(), [], 0
                for s, e, k in sorted((s, e, k) for k, s, e in all_spans(text or "", share.value)[1]):
                    if s >= pos:
                        out += [text[pos:s], mark.format(KINDS[k])]
                        pos = e
                new.append(None if text is None else "".join(out) + text[pos:])
            yield batch.set_column(at, "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
