"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base are four patterns (email, ip, card, phone) as the contract states them.  The field adds spans they
miss.  A text's blank-separated tokens that hold a digit, ``@`` or a cue of ``SECRET`` are marked; they and the ``LONGEST`` - 1 tokens on
either side form zones (merged where they overlap).  Inside a zone every run of at most ``LONGEST`` tokens with a marked one and
every single token, stripped of punctuation at its ends, is a candidate span of each kind, and a single token may stay outside.  Whole-span features (shape, length, digits, checksum, address form, words around) score candidates,
transition weights score neighbours, and dynamic programming over the bounded spans picks boundaries and kinds together.
A zone has every candidate run around its marked tokens; what lies outside of all zones is further than a run from any of them.

Training maximises the likelihood of segmentations labelled by the base patterns and by ``SECRET`` on at most ``SAMPLE``
zones of the corpus (the first by a hash, ``SHOWN`` tokens of each), together with generated variants: phones without country
code, keys of other prefixes, spaced phones and addresses, secrets without digits, and dates, prices, numbers and cues that are no entity.  Everything else covers whole texts.

Nulls: a null text is empty; rows without a doc_id are scored; repeated rows are scored each; an empty table gives
an empty result (and a model of generated zones only); other columns are ignored.
"""
from __future__ import annotations

import bisect
import hashlib
import itertools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediaguard.llm import tokens

KINDS = ["email", "ip", "card", "phone", "secret"]
BASE = KINDS[:4]
LONGEST, SAMPLE, SHOWN = 6, 1500, 12
STRIDE, SNIPPET = 512, 400   # tokens of a zone that are scored at once; characters of a zone that teach
FEATURES, ROUNDS, RATE, RIDGE = 1 << 13, 40, 0.1, 1e-3

# fixed values: the base patterns of the contract, split where that keeps the search linear
_HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SECRET = re.compile(r"AKIA[0-9A-Z]{16}|(?:password|passwd|secret|token|api_?key)\s?[=:]\s?\"?[A-Za-z0-9_\-/+]{12,}", re.I)

_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = "\"'`,.;:!?()[]{}<>"
MARK = r"[0-9@]|(?i:akia|password|passwd|secret|token|api_?key)"
_MARK = re.compile(MARK)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(s: str) -> str:
    return re.sub("[^0-9]", "", s)


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 3 or (len(p) == 3 and p <= "255")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per kind."""
    found = []
    at, done = text.find("@"), 0
    while at >= 0:  # each match holds one @: look both ways from it
        host = _HOST.match(text, at + 1)
        if host is not None:
            start = at
            while start > done and text[start - 1].isascii() and (text[start - 1].isalnum() or text[start - 1] in "._%+-"):
                start -= 1
            if start < at:
                found.append((start, host.end(), "email"))
                done = host.end()
        at = text.find("@", at + 1)
    for m in _DOTTED.finditer(text):
        parts = [(p.start() + m.start(), p.end() + m.start(), p[0]) for p in re.finditer("[0-9]+", m[0])] if m[0].count(".") >= 3 else []
        for i in range(0, len(parts) - 3, 4):
            if all(_small(p[2]) for p in parts[i:i + 4]):
                found.append((parts[i][0], parts[i + 3][1], "ip"))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 40:
            d = _digits(m[0])
            if 12 <= len(d) <= 19 and luhn(d):
                found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def zones(text: str) -> Iterator[tuple[np.ndarray, list[str]]]:
    """Each zone's tokens (start, end) and the two words before and one after it."""
    own = np.fromiter((x for m in _TOKEN.finditer(text) for x in m.span()), np.int64).reshape(-1, 2)
    word = lambda i: text[slice(*own[i])].lower() if 0 <= i < len(own) else ""
    begin, end = 0, 0
    for i, (a, b) in enumerate(own):
        if not _MARK.search(text, a, b):
            continue
        if end and i - LONGEST + 1 >= end:
            yield own[begin:end], [word(begin - 2), word(begin - 1), word(end)]
            end = 0
        begin, end = begin if end else max(0, i - LONGEST + 1), min(len(own), i + LONGEST)
    if end:
        yield own[begin:end], [word(begin - 2), word(begin - 1), word(end)]


def _strip(text: str, a: int, b: int) -> tuple[int, int]:
    while a < b and text[a] in _EDGE and not (text[a] == "(" and text[a + 1:a + 2].isdigit()):
        a += 1
    while b > a and text[b - 1] in _EDGE:
        b -= 1
    return a, b


def _shape(s: str) -> str:
    s = re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", s)))
    return re.sub(r"((?:[aA9]){2})(?:[aA9])+", r"\1*", s)[:24]


def features(s: str, around: tuple[str, str, str], n: int) -> list[int]:
    """Hashed whole-span features of a candidate of ``n`` tokens."""
    d = _digits(s)
    low = s.lower()
    own = [
        "bias", f"shape {_shape(s)}", f"tokens {n}", f"digits {min(len(d), 20)}", f"length {min(len(s), 48) // 3}",
        f"before {around[1][:12]}", f"before2 {around[0][:12]} {around[1][:12]}", f"after {around[2][:12]}", f"first {_shape(s[:1])}", f"last {_shape(s[-1:])}",
        f"head {low[:4] if not low[:1].isdigit() else '9'}", f"at {s.count('@')}", f"plus {s[:1] == '+'}", f"sign {'=' in s or ':' in s}",
        f"luhn {12 <= len(d) <= 19 and luhn(d)} {len(d) == len(re.sub('[ -]', '', s))}", f"ip {s.count('.') == 3 and all(p.isdigit() and _small(p) for p in s.split('.'))}",
        f"mail {re.fullmatch(r'[^@ ]+@[^@ ]+[.][a-z]{2,}', low) is not None}", f"key {re.fullmatch(r'[A-Z0-9]{16,}', s) is not None and not s.isdigit()}",
        f"hex {re.search(r'[0-9a-f]{16,}', low) is not None and not s.isdigit()}", f"phone {re.fullmatch(r'[+]?[0-9 ().-]+', s) is not None} {7 <= len(d) <= 15}"]
    return [zlib.crc32(f.encode()) % FEATURES for f in own]


class Zone:
    """The candidate spans of a zone: token bounds, characters, features.  ``starts`` bounds the tokens they begin at."""

    def __init__(self, text: str, own, around: list[str], starts: int | None = None):
        own = [(int(a), int(b)) for a, b in own]
        self.n, self.bounds, self.chars, feats = len(own), [], [], []
        words = [text[a:b].lower() for a, b in own]
        marked = np.concatenate([[0], np.cumsum([_MARK.search(w) is not None for w in words])])
        for i in range(self.n if starts is None else starts):
            for j in range(i + 1, min(self.n, i + LONGEST) + 1):
                if j > i + 1 and marked[i] == marked[j]:
                    continue
                a, b = _strip(text, own[i][0], own[j - 1][1])
                before = (words[i - 2] if i > 1 else around[1] if i == 1 else around[0], words[i - 1] if i else around[1], words[j] if j < self.n else around[2])
                self.bounds.append((i, j))
                self.chars.append((a, b))
                feats.append(features(text[a:b], before, j - i))
        self.feats = np.array(feats, np.int64)


class Field:
    """Weights of the features per kind (0 is outside) and of neighbouring kinds."""

    def __init__(self):
        self.w = np.zeros((FEATURES, len(KINDS) + 1))
        self.move = np.zeros((len(KINDS) + 1, len(KINDS) + 1))

    def scores(self, z: Zone) -> np.ndarray:
        s = self.w[z.feats].sum(axis=1)
        for k, (i, j) in enumerate(z.bounds):
            if j - i > 1:
                s[k, 0] = -np.inf
            a, b = z.chars[k]
            if a == b:
                s[k, 1:] = -np.inf
        return s

    def best(self, text: str, own, around: list[str]) -> list[tuple[int, int, str]]:
        """(start, end, kind) of the entities of the best segmentation of a zone's tokens.

        Candidates are made and scored ``STRIDE`` tokens at a time; of each token only its best scores and where they came
        from are kept, so a zone may be as long as a text.
        """
        n, k = len(own), len(KINDS) + 1
        top = np.full((n + 1, k), -np.inf)
        size, prior = np.zeros((n + 1, k), np.uint8), np.zeros((n + 1, k), np.uint8)
        top[0, 0] = 0
        word = lambda i: text[own[i][0]:own[i][1]].lower()
        for lo in range(0, n, STRIDE):
            hi = min(n, lo + STRIDE)
            end = min(n, hi + LONGEST - 1)
            z = Zone(text, own[lo:end], [word(lo - 2) if lo else around[0], word(lo - 1) if lo else around[1], word(end) if end < n else around[2]], hi - lo)
            s = self.scores(z)
            for c, (i, j) in enumerate(z.bounds):  # bounds are ordered by their start
                step = top[lo + i][:, None] + self.move
                new = step.max(axis=0) + s[c]
                better = new > top[lo + j]
                if better.any():
                    top[lo + j, better], size[lo + j, better], prior[lo + j, better] = new[better], j - i, step.argmax(axis=0)[better]
        at, y, found = n, int(top[n].argmax()), []
        while at:
            i = at - int(size[at, y])
            if y:
                found.append((*_strip(text, int(own[i][0]), int(own[at - 1][1])), KINDS[y - 1]))
            at, y = i, int(prior[at, y])
        return found[::-1]

    def marginals(self, z: Zone) -> tuple[np.ndarray, np.ndarray]:
        """Expected use of each (candidate, kind) and of each transition."""
        s, k = self.scores(z), len(KINDS) + 1
        fwd, bwd = np.full((z.n + 1, k), -np.inf), np.full((z.n + 1, k), -np.inf)
        fwd[0, 0], bwd[z.n] = 0, 0
        into = [np.logaddexp.reduce(fwd[i][:, None] + self.move, axis=0) if not i else None for i in range(z.n + 1)]
        for c, (i, j) in enumerate(z.bounds):
            if into[i] is None:
                into[i] = np.logaddexp.reduce(fwd[i][:, None] + self.move, axis=0)
            fwd[j] = np.logaddexp(fwd[j], into[i] + s[c])
        for c in range(len(z.bounds) - 1, -1, -1):
            i, j = z.bounds[c]
            bwd[i] = np.logaddexp(bwd[i], np.logaddexp.reduce(self.move + (s[c] + bwd[j])[None, :], axis=1))
        total = np.logaddexp.reduce(fwd[z.n])
        use, moves = np.zeros_like(s), np.zeros((k, k))
        for c, (i, j) in enumerate(z.bounds):
            pair = np.exp(fwd[i][:, None] + self.move + (s[c] + bwd[j])[None, :] - total)
            use[c], moves = pair.sum(axis=0), moves + pair
        return use, moves

    @staticmethod
    def grid(zones_of: list[Zone]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Zone, start and length - 1 of each candidate of all zones, and the tokens of each zone."""
        bounds = np.concatenate([np.array(z.bounds) for z in zones_of])
        return np.repeat(np.arange(len(zones_of)), [len(z.bounds) for z in zones_of]), bounds[:, 0], bounds[:, 1] - bounds[:, 0] - 1, np.array([z.n for z in zones_of])

    def expected(self, s: np.ndarray, zone: np.ndarray, start: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``marginals`` of the candidates of many zones at once, the transitions summed; ``s`` are their scores."""
        k, most = len(KINDS) + 1, int(n.max())
        cells = np.full((len(n), most, LONGEST, k), -np.inf)
        cells[zone, start, size] = s
        fwd, bwd = (np.full((len(n), most + 1, k), -np.inf) for _ in range(2))
        into = np.full((len(n), most + 1, k), -np.inf)
        fwd[:, 0, 0] = 0
        bwd[np.arange(len(n)), n] = 0
        moved = lambda x: np.logaddexp.reduce(x[:, :, None] + self.move, axis=1)
        for i in range(most):
            into[:, i] = moved(fwd[:, i])
            for j in range(i + 1, min(most, i + LONGEST) + 1):
                fwd[:, j] = np.logaddexp(fwd[:, j], into[:, i] + cells[:, i, j - i - 1])
        ahead = np.full_like(fwd, -np.inf)  # what follows from a start on, by the kind that begins there
        for i in range(most - 1, -1, -1):
            for j in range(i + 1, min(most, i + LONGEST) + 1):
                ahead[:, i] = np.logaddexp(ahead[:, i], cells[:, i, j - i - 1] + bwd[:, j])
            bwd[:, i] = np.logaddexp(bwd[:, i], np.logaddexp.reduce(self.move + ahead[:, i][:, None, :], axis=2))
        total = np.logaddexp.reduce(fwd[np.arange(len(n)), n], axis=1)
        use = np.exp(into[zone, start] + s + bwd[zone, start + size + 1] - total[zone, None])
        moves = np.exp(fwd[:, :-1, :, None] + self.move + ahead[:, :-1, None, :] - total[:, None, None, None]).sum(axis=(0, 1))
        return use, moves

    def fit(self, data: list[tuple[Zone, dict[int, int]]]) -> "Field":
        """``data``: zones with the kind of each candidate that is an entity."""
        truth, truth_moves = [], np.zeros_like(self.move)
        for z, gold in data:
            use, at, prev = np.zeros((len(z.bounds), len(KINDS) + 1)), 0, 0
            by_start = {z.bounds[c][0]: (c, y) for c, y in gold.items()}
            single = {b: c for c, b in enumerate(z.bounds)}
            while at < z.n:
                c, y = by_start.get(at, (single[at, at + 1], 0))
                use[c, y] = 1
                truth_moves[prev, y] += 1
                at, prev = z.bounds[c][1], y
            truth.append(use)
        zones_of = [z for z, _ in data]
        feats, grid = np.concatenate([z.feats for z in zones_of]), self.grid(zones_of)
        sums = [np.zeros_like(self.w), np.zeros_like(self.move)]
        for _ in range(ROUNDS):  # full batches, steps scaled by past gradients
            uses, moves = self.expected(np.concatenate([self.scores(z) for z in zones_of]), *grid)
            off = uses - np.concatenate(truth)
            g = np.stack([np.bincount(feats.reshape(-1), np.repeat(c, feats.shape[1]), FEATURES) for c in off.T], axis=1)
            for i, (v, d) in enumerate(((self.w, g / len(data) + RIDGE * self.w), (self.move, (moves - truth_moves) / len(data) + RIDGE * self.move))):
                sums[i] += d * d
                v -= RATE * 5 * d / (np.sqrt(sums[i]) + 1e-6)
        return self


def labelled(text: str) -> list[tuple[Zone, dict[int, int]]]:
    """The zones of a snippet with labels from the base patterns and SECRET."""
    gold = base_spans(text) + [(m.start(), m.end(), "secret") for m in SECRET.finditer(text)]
    out = []
    for own, around in zones(text):
        z = Zone(text, own[:SHOWN], around)
        got, taken = {}, 0
        for a, b, kind in sorted(gold):
            for c, (i, j) in enumerate(z.bounds):
                x, y = z.chars[c]
                if i >= taken and x < y and (((x, y) == (a, b)) if kind != "secret" else (a <= x and y >= b >= x and j == i + 1) or (x <= a and b <= y and j == i + 1)):
                    got[c] = KINDS.index(kind) + 1
                    taken = j
                    break
        out.append((z, got))
    return out


def generated(n: int = 696, seed: int = 23) -> list[tuple[Zone, dict[int, int]]]:
    """Zones made from templates: entities in forms the base patterns miss, and numbers that are none."""
    r = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, r.integers(0, 10, k)))
    low = lambda k: "".join(chr(97 + c) for c in r.integers(0, 26, k))
    key = lambda k: "".join(r.choice(list("ABCDEFGHJKLMNPQRSTUVWXYZ23456789"), k))
    makers = [
        (lambda: f"({num(3)}) {num(3)}-{num(4)}", "phone"), (lambda: f"{num(3)}-{num(3)}-{num(4)}", "phone"), (lambda: f"+{1 + r.integers(9)} {num(3)} {num(3)} {num(4)}", "phone"),
        (lambda: f"{low(6)}.{num(2)}@mail{num(1)}.example.com", "email"), (lambda: f"{low(5)}@{low(6)}.org", "email"),
        (lambda: ".".join(str(x) for x in r.integers(1, 256, 4)), "ip"), (lambda: f"{key(4)}7{key(15)}", "secret"),
        (lambda: f"{r.choice(['password', 'pwd', 'secret', 'api_key'])}={num(3)}{low(3)}{num(8)}f0", "secret"), (lambda: f"{num(5)}{low(3)}{num(14)}af", "secret"),
        (lambda: num(int(r.integers(1, 7))), None), (lambda: f"20{num(2)}-0{1 + r.integers(9)}-1{num(1)}", None), (lambda: f"{num(2)}.{num(2)}", None),
        (lambda: f"{num(1)}:{num(2)}", None), (lambda: f"${num(2)},{num(3)}.{num(2)}", None), (lambda: f"{low(3)}{num(2)}", None), (lambda: f"{num(4)} {num(2)}", None),
        (lambda: f"{num(2)}.{num(1)}.{num(2)}", None), (lambda: f"@{low(6)}", None), (lambda: f"{num(3)} {num(5)} {num(2)}", None), (lambda: "4" + num(11) + "x", None),
        (lambda: f"{num(3)} - {num(3)} - {num(4)}", "phone"), (lambda: f"{low(5)} @ {low(6)}.{r.choice(['com', 'org', 'net'])}", "email"),
        (lambda: f"{r.choice(cues)}{r.choice(['=', ':'])}{low(int(r.integers(12, 24)))}", "secret"), (lambda: f"{r.choice(cues)} {r.choice(['=', ':'])} {low(int(r.integers(12, 24)))}", "secret"),
        (lambda: f"{r.choice(cues)}{r.choice(['=', ':'])} {low(int(r.integers(12, 24)))}", "secret"), (lambda: f"{r.choice(cues)} {low(int(r.integers(2, 12)))}", None),
        (lambda: f"{r.choice(cues)}{r.choice([',', '.', 's'])} {low(int(r.integers(12, 18)))}", None), (lambda: f"{num(1)} - {num(2)}", None), (lambda: f"{low(4)} @ {num(2)}", None)]
    cues = ["password", "passwd", "secret", "token", "api_key"]
    out = []
    for i in range(n):
        make, kind = makers[i % len(makers)]
        text = make()
        d, size = _digits(text), len(_TOKEN.findall(text))
        words = [[low(int(r.integers(1, 10))) + r.choice(["", "", "", ",", "."]) for _ in range(r.integers(LONGEST))] for _ in range(2)]
        text = " ".join([*words[0], text, *words[1]])
        z = Zone(text, [(m.start(), m.end()) for m in _TOKEN.finditer(text)], [low(4), r.choice([low(3), "the", "="]), low(4)])
        if kind is None and 12 <= len(d) <= 19 and luhn(d):
            continue
        at = len(words[0]), len(words[0]) + size
        if kind == "secret":  # the token with the value, as in ``labelled``
            at = at[1] - 1, at[1]
        whole = [c for c, b in enumerate(z.bounds) if b == at]
        out.append((z, {whole[0]: KINDS.index(kind) + 1} if kind else {}))
    return out


def _snippets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in tokens.pieces(batches):
        texts = b["text"].filter(pc.match_substring_regex(b["text"], MARK))
        out = []
        for t in texts.to_pylist():
            for own, around in zones(t):
                out.append(f"{around[0]} {around[1]} {t[own[0][0]:own[min(len(own), SHOWN) - 1][1]][:SNIPPET]} {around[2]}")
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], ["snippet"])


def fit(docs: DataFrame) -> Field:
    """A field from a bounded sample of zones and the generated ones."""
    own = docs.where("text is not null").select(F.col("text").cast("string").alias("text")).mapInArrow(_snippets, "snippet string")
    rows = own.orderBy(F.xxhash64("snippet"), "snippet").limit(SAMPLE).collect()
    return Field().fit([x for r in rows for x in labelled(r.snippet)] + generated())


def find(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the base and what the field adds beside them."""
    base = base_spans(text)
    more = []
    starts = [s for s, _, _ in sorted(base)]
    reach = list(itertools.accumulate((e for _, e, _ in sorted(base)), max))  # the furthest end among the spans so far
    for own, around in zones(text):
        for a, b, kind in field.best(text, own, around):
            before = bisect.bisect_left(starts, b)  # spans that begin before the end
            if not before or reach[before - 1] <= a:
                more.append((a, b, kind))
    return base, sorted(base + more, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs``: doc_id, base counts, base_sha256, spans."""
    none = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in tokens.pieces(batches):
            texts = b["text"].fill_null("")
            counts = {k: np.zeros(b.num_rows, np.int64) for k in BASE}
            sha, spans = [none] * b.num_rows, [""] * b.num_rows
            for i in np.flatnonzero(pc.match_substring_regex(texts, MARK).to_numpy(zero_copy_only=False)):
                base, every = find(texts[int(i)].as_py(), field)
                for _, _, k in base:
                    counts[k][i] += 1
                sha[i], spans[i] = hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(every)
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array(counts[k]) for k in BASE], pa.array(sha), pa.array(spans)],
                                             ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
