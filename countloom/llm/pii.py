"""Personal data in whole texts: fixed patterns, and a linear-chain conditional random field for what they miss.

The patterns find email, ip, card and phone as given by their formats. A linear-chain CRF over word-shape features adds spans in
other notations ("name (at) host (dot) com", "555-123-4567", "10[.]0[.]0[.]7", "4111_1111_1111_1111"). It is trained on a small labelled
table of short sentences with all four kinds by gradient ascent on the exact likelihood and decoded by Viterbi, both in numpy.

Chains are the maximal runs of words in which each is at most ``reach`` words from a marked one (a digit or an at sign in it); other words
are outside by definition, so the decoder's work follows the number of such places. All chains of a
batch are decoded together, position by position. A decoded span counts if its mean gain (its labels' weights over those of outside, per word) is at least ``margin``, it does not touch a span of the patterns and what it says can be of its kind: a card passes Luhn, the parts
of an ip are at most 255, a phone has 9 to 13 digits, an email has one at sign and a dot. How it is written is left to the field.

Positions are code points, the end exclusive. Defined results: null texts are empty; repeated rows get equal results. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from countloom.llm.tables import text_key, texts

#: The kinds in order and their patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_COMPILED = {kind: re.compile(pattern) for kind, pattern in PATTERNS.items()}
# A match takes its last run of digits whole, so none starts inside a run; saying so keeps long runs linear.
_COMPILED["ip"] = re.compile("(?<![0-9])" + PATTERNS["ip"])
#: The two sides of an email's at sign.
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(PATTERNS["email"].partition("@")[2])
#: Without these a text cannot match.
_NEEDS = {"ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}
_DIGITS = re.compile("[0-9]")
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_MARKED = re.compile(r"[0-9@]|\((?:at|AT)\)|\[(?:at|AT)\]")

#: The labelled table: words in {kind ...} belong to one span of that kind.
LABELLED = [
    "please write to {email anna.k (at) mail (dot) org} today",
    "contact {email info [at] shop [dot] com} for help",
    "my address is {email j.smith (at) example (dot) net} thanks",
    "send it to {email max77 (at) host9 (dot) example (dot) com} soon",
    "escriba a {email luis (at) correo (dot) es} por favor",
    "ecrivez a {email marie.d [at] poste [dot] fr} merci",
    "schreiben sie {email kurt_b (at) netz (dot) de} bitte",
    "mail {email team (at) firm (dot) io} or call {phone 555-123-4567} now",
    "call {phone 555-123-4567} after six",
    "ring me at {phone (212) 555-0134} tonight",
    "tel {phone 030-555-1234} fragen",
    "phone {phone (743) 555-3824} is busy",
    "appelez le {phone 01-555-23-45} demain",
    "llame al {phone 415-555-0199} hoy",
    "the number {phone 202-555-0175} is new",
    "fax {phone (030) 555-0112} und mehr",
    "we met at 10 and left at 12",
    "in 1999 there were 250 people in 12 rooms",
    "page 12 of 340 and line 7",
    "it costs 19.99 or 25.50 in 2020",
    "version 2.4 came after 1.9 in may",
    "12 of 15 were there on 2021-03-04",
    "on 03-04-2021 we saw 17 of them",
    "the code A1B2C3 and x9y8z7 are not numbers",
    "token=9f8e7d6c5b4a or key=a1b2c3d4e5",
    "AKIA99XYZ77ABC and id 77-A",
    "sec. 4 (at) the end of part 5",
    "we were (at) home (dot) and 3 left",
    "license 2.0 and 3.1 apply",
    "score 3-2 and 10-7 at half time",
    "room 12-34 in block 5-6",
    "isbn 978-3-16-148410-0 is a book",
    "see 1.2. and 3. below",
    "add 50% of 7 and 3+4",
    "from 10-12 to 14-16 daily",
    "an @ sign and @name with #tag",
    "host {ip 192[.]168[.]1[.]20} is down",
    "ping {ip 10[.]0[.]0[.]7} first",
    "from {ip 172(.)16(.)4(.)99} to us",
    "server {ip 10-20-30-40} rebooted",
    "el servidor {ip 192[.]0[.]2[.]14} falla",
    "at {ip 203 (dot) 0 (dot) 113 (dot) 9} we saw it",
    "blocked {ip 198[.]187[.]164[.]25} again",
    "la ip {ip 45[.]113[.]208[.]130} entra",
    "hote {ip 151[.]101[.]193[.]140} absent",
    "sperre {ip 23[.]45[.]67[.]89} sofort",
    "von {ip 172-16-0-5} kam es",
    "adresse {ip 198 [dot] 51 [dot] 100 [dot] 23} bloquee",
    "my card {card 4111_1111_1111_1111} expired",
    "pay with {card 4111.1111.1111.1111} please",
    "carte {card 5500/0000/0000/0004} refusee",
    "karte {card 5500.0000.0000.0004} gesperrt",
    "tarjeta {card 4012_8888_8888_1881} y mas",
    "card no {card 3782/822463/10005} lost",
    "number {card 6011_0009_9013_9424} again",
    "file 2021_03_04_1200 and build 7_2",
    "the path 12/34/56 or 2020/01/02 there",
    "sum of 1.250.000 and 12.500.000 euro",
    "section 4.1.2 or 4.1.2.1 of it",
    "log[3] and a[1] in row[12]",
    "at 12:30:45 on 2021-03-04 it ended",
]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (2 if k % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def passes(kind: str, found: str) -> bool:
    """Whether a match of the kind's pattern counts."""
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in found.split("."))
    if kind == "card":
        digits = "".join(_DIGITS.findall(found))
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(_DIGITS.findall(found)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the email pattern, from each at sign to both sides: an at sign ends the run of letters before it, so runs are read once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        before = text[done:at]
        start = done + len(before.rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            out.append((start, host.end()))
        done = host.end() if host else at + 1
        at = text.find("@", done)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the patterns, kind by kind."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind in KINDS[1:]:
        if _NEEDS[kind].search(text):
            out += [(kind, m.start(), m.end()) for m in _COMPILED[kind].finditer(text) if passes(kind, m.group())]
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


# The conditional random field.

LABELS = ["O", *[f"{part}-{kind}" for kind in KINDS for part in "BI"]]
_ALLOWED = np.array([[not b.startswith("I") or (a[0] in "BI" and a[2:] == b[2:]) for b in LABELS] for a in LABELS])
_START = np.array([not b.startswith("I") for b in LABELS])


def shape(word: str) -> str:
    """Runs of letters, digits and signs, with the lengths of digit runs."""
    core = word.rstrip(".,;:!?")
    if re.fullmatch(r"[(\[](?:at|AT|dot|DOT)[)\]]", core):
        return core.lower().strip("()[]") + "-sign"
    core = re.sub(r"[A-Za-z\u0080-\U0010ffff]+", "a", core)
    core = re.sub(r"[0-9]+", lambda m: f"<{min(len(m.group()), 5)}>", core)
    return core[:40]


def features(words: list[str]) -> list[list[str]]:
    shapes = [shape(w) for w in words]
    padded = ["^", *shapes, "$"]
    out = []
    for i, word in enumerate(words):
        digits = min(sum(c.isdigit() for c in word), 12)
        form = re.sub("<[0-9]>", "9", shapes[i])
        out.append(["bias", f"f={form}", f"f+d={form}|{digits}", f"s={shapes[i]}", f"p={padded[i]}", f"n={padded[i + 2]}", f"p+s={padded[i]}|{shapes[i]}", f"s+n={shapes[i]}|{padded[i + 2]}", f"d={digits}"])
    return out


@dataclass
class Field:
    """Weights of features by label (the last row, of unknown features, is 0) and of label pairs."""

    index: dict[str, int]
    weights: np.ndarray
    steps: np.ndarray

    def emissions(self, rows: list[list[str]]) -> np.ndarray:
        unknown = len(self.weights) - 1
        ids = np.array([[self.index.get(f, unknown) for f in row] for row in rows], dtype=np.int64)
        return self.weights[ids].sum(axis=1)


def _read(sentence: str) -> tuple[list[str], list[int]]:
    words, labels, kind, first = [], [], "", False
    for piece in sentence.split():
        if piece.startswith("{"):
            kind, first = piece[1:], True
            continue
        ends = piece.endswith("}")
        words.append(piece.rstrip("}"))
        labels.append(LABELS.index(f"{'B' if first else 'I'}-{kind}") if kind else 0)
        first = False
        if ends:
            kind = ""
    return words, labels


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


def train(table: list[str] = LABELLED, rounds: int = 200, rate: float = 0.5, penalty: float = 0.02) -> Field:
    """Weights of the labelled table by full-batch ascent on the penalised likelihood (AdaGrad steps)."""
    sentences = [_read(s) for s in table]
    rows = [features(words) for words, _ in sentences]
    names = sorted({f for row in rows for fs in row for f in fs})
    index = {f: k for k, f in enumerate(names)}
    weights = np.zeros((len(names) + 1, len(LABELS)))
    steps = np.zeros((len(LABELS), len(LABELS)))
    seen_w, seen_s = np.full_like(weights, 1e-6), np.full_like(steps, 1e-6)
    barred = np.where(_ALLOWED, 0.0, -1e4)
    begin = np.where(_START, 0.0, -1e4)
    coded = [np.array([[index[f] for f in fs] for fs in row]) for row in rows]
    for _ in range(rounds):
        grad_w, grad_s = -penalty * weights, -penalty * steps
        for ids, (_, labels) in zip(coded, sentences):
            emit, move = weights[ids].sum(axis=1), steps + barred
            n = len(labels)
            ahead, behind = np.zeros((n, len(LABELS))), np.zeros((n, len(LABELS)))
            ahead[0] = emit[0] + begin
            for t in range(1, n):
                ahead[t] = emit[t] + _logsum(ahead[t - 1][:, None] + move, 0)
            for t in range(n - 2, -1, -1):
                behind[t] = _logsum(move + (emit[t + 1] + behind[t + 1])[None], 1)
            total = _logsum(ahead[-1], 0)
            expected = np.exp(ahead + behind - total)
            observed = np.zeros_like(expected)
            observed[np.arange(n), labels] = 1
            for k in range(ids.shape[1]):
                np.add.at(grad_w, ids[:, k], observed - expected)
            for t in range(1, n):
                pair = np.exp(ahead[t - 1][:, None] + move + (emit[t] + behind[t])[None] - total)
                grad_s -= pair
                grad_s[labels[t - 1], labels[t]] += 1
        grad_w[-1] = 0
        seen_w += grad_w**2
        seen_s += grad_s**2
        weights += rate * grad_w / np.sqrt(seen_w)
        steps += rate * grad_s / np.sqrt(seen_s)
    return Field(index, weights, np.where(_ALLOWED, steps, -1e4))


def viterbi(emissions: np.ndarray, lengths: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Best labels of many chains at once; ``emissions`` holds them one after the other."""
    n_labels = emissions.shape[1]
    begins = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    begins, sorted_lengths = begins[order], lengths[order]
    back = np.zeros((len(emissions), n_labels), np.int8)
    score = emissions[begins] + np.where(_START, 0.0, -1e4)
    final = np.zeros((len(lengths), n_labels))
    for t in range(int(sorted_lengths[0])):
        live = int(np.searchsorted(-sorted_lengths, -t, "left"))
        if t:
            options = score[:live, :, None] + steps[None]
            best = options.argmax(axis=1)
            back[begins[:live] + t] = best
            score = np.take_along_axis(options, best[:, None, :], 1)[:, 0] + emissions[begins[:live] + t]
        final[:live] = score[:live]
    labels = np.zeros(len(emissions), np.int64)
    state = final.argmax(axis=1)
    for t in range(int(sorted_lengths[0]) - 1, -1, -1):
        live = int(np.searchsorted(-sorted_lengths, -t, "left"))
        at = begins[:live] + t
        labels[at] = state[:live]
        state[:live] = back[at, state[:live]]
    return labels


_AT = re.compile(r"@|[(\[](?:at|AT)[)\]]")
_DOT = re.compile(r"[(\[](?:dot|DOT|\.)[)\]]|\.")


def plausible(kind: str, found: str) -> bool:
    """Whether what a decoded span says can be of its kind, however it is written."""
    numbers = re.findall("[0-9]+", found)
    if kind == "ip":
        return len(numbers) == 4 and passes("ip", ".".join(numbers))
    if kind == "phone":
        return 9 <= sum(map(len, numbers)) <= 13
    if kind == "card":
        return passes("card", found)
    return len(_AT.findall(found)) == 1 and _DOT.search(found, _AT.search(found).end()) is not None


def chains(words: list[re.Match], reach: int) -> list[tuple[int, int]]:
    """Word ranges around marked words."""
    out: list[list[int]] = []
    for i, m in enumerate(words):
        if _MARKED.search(m.group()):
            first, last = max(0, i - reach), min(len(words), i + reach + 1)
            if out and first <= out[-1][1]:
                out[-1][1] = last
            else:
                out.append([first, last])
    return [(a, b) for a, b in out]


def _marks_near(text: str, reach: int) -> list[tuple[list[str], list[tuple[int, int]]]]:
    """(words, their positions) of every chain of a text."""
    if not _MARKED.search(text):
        return []
    words = list(_WORDS.finditer(text))
    return [([m.group() for m in words[a:b]], [m.span() for m in words[a:b]]) for a, b in chains(words, reach)]


def added_spans(several: list[str], bases: list[list[tuple[str, int, int]]], field: Field, reach: int, margin: float) -> list[list[tuple[str, int, int]]]:
    """The spans that the field adds to each of several texts."""
    out: list[list[tuple[str, int, int]]] = [[] for _ in several]
    found = [(i, words, spans) for i, text in enumerate(several) for words, spans in _marks_near(text, reach)]
    if not found:
        return out
    emissions = field.emissions([row for _, words, _ in found for row in features(words)])
    lengths = np.array([len(words) for _, words, _ in found])
    labels = viterbi(emissions, lengths, field.steps)
    at = 0
    for (i, words, spans), n in zip(found, lengths.tolist()):
        own, emit = labels[at : at + n], emissions[at : at + n]
        at += n
        t = 0
        while t < n:
            name = LABELS[own[t]]
            if name[0] != "B":
                t += 1
                continue
            last = t + 1
            while last < n and LABELS[own[last]] == f"I-{name[2:]}":
                last += 1
            gain = sum(emit[k, own[k]] - emit[k, 0] for k in range(t, last)) / (last - t)
            start, end = spans[t][0], spans[last - 1][1]
            text = several[i][start:end]
            end -= len(text) - len(text.rstrip(".,;:!?"))
            free = all(end <= a or b <= start for _, a, b in bases[i])
            if free and gain >= margin and plausible(name[2:], several[i][start:end]):
                out[i].append((name[2:], start, end))
            t = last
    return out


def detect(docs: DataFrame, reach: int = 3, margin: float = 1.0, table: list[str] = LABELLED) -> DataFrame:
    """(doc_id, text_key, base, added): spans as lists of (kind, start, end) of every document."""
    model = docs.sparkSession.sparkContext.broadcast(astuple(train(table)))
    kind = "array<struct<kind: string, start: int, end: int>>"
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def as_rows(spans: list[list[tuple[str, int, int]]]) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in row] for row in spans], span)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for batch in batches:
            several = [t or "" for t in batch.column(1).to_pylist()]
            bases = [base_spans(t) for t in several]
            more = added_spans(several, bases, field, reach, margin)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), as_rows(bases), as_rows(more)], names=["doc_id", "text_key", "base", "added"]
            )

    rows = texts(docs).select("doc_id", "text", text_key().alias("text_key"))
    return rows.mapInArrow(run, f"doc_id long, text_key long, base {kind}, added {kind}")


def digests(found: DataFrame) -> DataFrame:
    """doc_id, the counts by kind, base_sha256 and spans of detected spans."""

    rank = "CASE x.kind " + " ".join(f"WHEN '{kind}' THEN {k}" for k, kind in enumerate(KINDS)) + " END"

    def listed(spans: str):
        return F.expr(
            f"array_join(transform(array_sort(transform({spans}, x -> struct(x.start AS start, {rank} AS rank, x.end AS end, x.kind AS kind))), "
            "y -> concat(y.kind, ':', y.start, ':', y.end)), ',')"
        )

    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("concat(base, added)").alias("spans"))


def redact(docs: DataFrame, reach: int = 3, margin: float = 1.0, table: list[str] = LABELLED) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; n_chars follows the text. Overlapping spans become one, of the first kind."""
    model = docs.sparkSession.sparkContext.broadcast(astuple(train(table)))
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            several = [t or "" for t in batch.column(at).to_pylist()]
            bases = [base_spans(t) for t in several]
            more = added_spans(several, bases, field, reach, margin)
            out = []
            for text, spans, was in zip(several, (b + m for b, m in zip(bases, more)), batch.column(at)):
                if not spans:
                    out.append(text if was.is_valid else None)
                    continue
                parts, done = [], 0
                for kind, a, b in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]))):
                    if a >= done:
                        parts += [text[done:a], f"<{kind.upper()}>"]
                    done = max(done, b)
                out.append("".join([*parts, text[done:]]))
            columns = [pa.array(out, pa.string()) if name == "text" else batch.column(k) for k, name in enumerate(names)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    out = docs.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        changed = F.length("text").cast(schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(changed))
    return out
