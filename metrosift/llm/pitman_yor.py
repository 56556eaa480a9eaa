"""A hierarchical Pitman-Yor language model, seated by Gibbs sampling, and its scores.

Contexts are the actual words before (or the start of a text). A context's restaurant
seats the occurrences of a word at tables; each table is a customer of the parent
restaurant that all contexts share, whose own tables draw from a base that leaves half
its mass to unseen words. A step of the sampler removes all customers of a word from one
restaurant and seats them anew by their exact distribution given all other customers.

Words are dealt by hash into buckets: a word's seating in all its contexts is in one
bucket. After each sweep the buckets exchange the tables of all contexts and the totals,
so every sweep starts from exact ones. Texts never meet in one place: parts of the corpus
send arrays of distinct pairs of words, and get back, in the same order, what their
texts' scores need.
"""

from __future__ import annotations

import pickle
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from metrosift.llm.common import runs, table
from metrosift.llm.segments import hashes, utf8, words

SWEEPS, BURN_IN = 5, 2
UNSEEN_MASS, PARENT_STRENGTH, STRENGTH = 0.5, 10.0, 10.0
#: Bytes of text in a part, and of the corpus for each bucket of words; both counts grow with the input.
PART_BYTES, BUCKET_BYTES = 6 << 20, 24 << 20
#: Customers of one word in one restaurant whose tables are drawn by their exact distribution; more are seated after those.
EXACT = 256
_END, _START = np.uint64(0x5851F42D4C957F2D), np.uint64(0x9E3779B97F4A7C15)
#: Tables weighed at a time.
_STEP = 1 << 20
_WHOLE = (np.uint8, np.uint16, np.uint32, np.uint64)
#: Contexts are named by the upper bits of their hashes.
_CONTEXT = np.uint64(0xFFFFFFFFFFFF0000)


def token_pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens in order: the word's hash, that of the word before it, and the text's number.

    Every text ends in one end token, the only one an empty or null text has.
    """
    data, offsets = utf8(texts)
    data, starts, ends, text = words(data, offsets)
    n, count = len(offsets) - 1, np.bincount(text, minlength=len(offsets) - 1)
    total = len(starts) + n
    last = np.cumsum(count + 1) - 1
    of_word = np.ones(total, bool)
    of_word[last] = False
    ids = np.full(total, _END)
    ids[of_word] = hashes(data, starts, ends, 1)[0]
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    before[np.concatenate(([0], last[:-1] + 1))[:n]] = _START
    return ids, before, np.repeat(np.arange(n), count + 1)


def bucket_cuts(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where sorted keys pass from one bucket to the next: buckets are equal ranges of the hash."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    return np.concatenate(([0], np.searchsorted(keys, bounds), [len(keys)]))


def seat(customers: np.ndarray, new_mass: np.ndarray, discount: float, rng: np.random.Generator,
         seated: int = 1, tables: np.ndarray | None = None) -> np.ndarray:
    """Tables after seating ``customers`` of each dish one by one, the first ``seated`` of which have ``tables``.

    With n seated at t tables the next opens a table with odds new_mass : n - discount * t.
    From the 64th on customers come in groups of an eighth of those seated, whose odds
    hardly differ.
    """
    order = np.argsort(-customers, kind="stable")
    c, mass = customers[order], new_mass[order]
    tables = (c > 0).astype(np.float64) if tables is None else tables[order].astype(np.float64)
    n, rising = seated, -c
    while True:
        live = int(np.searchsorted(rising, -n))  # those with more than n customers come first
        if not live:
            break
        step = 1 if n < 64 else n // 8
        p = mass[:live] / (mass[:live] + n - discount * tables[:live])
        if step == 1:
            tables[:live] += rng.random(live) < p
        else:
            tables[:live] += rng.binomial(np.minimum(step, c[:live] - n), p)
        n += step
    out = np.empty_like(tables)
    out[order] = tables
    return out


@lru_cache(maxsize=4)
def _arrangements(discount: float) -> np.ndarray:
    """log of the weight of all ways to seat c customers at t tables, at [c, t - 1]: generalized Stirling numbers."""
    out = np.full((EXACT + 1, EXACT), -np.inf)
    out[1, 0] = 0.0
    t = np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        joined = out[c, :c] + np.log(c - discount * t[:c])
        out[c + 1, :c] = joined
        out[c + 1, 1:c + 1] = np.logaddexp(out[c + 1, 1:c + 1], out[c, :c])
    return out


def draw_tables(customers: np.ndarray, discount: float, weigh, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish, drawn by P(t) ~ arrangements(c, t) * the product of what its first t tables weigh.

    ``weigh(rows, k)`` is the weight of the table after k others. Customers beyond ``EXACT``
    are seated after those, with the weight the next table then has.
    """
    out = customers.astype(np.float64)
    several = np.flatnonzero(customers > 1)
    exact = np.minimum(customers[several], EXACT)
    ways, at, ends = _arrangements(round(discount, 6)), 0, np.cumsum(exact)
    while at < len(several):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _STEP, "right")))
        size = exact[at:stop]
        first = np.cumsum(size) - size
        row = np.repeat(np.arange(len(size)), size)
        k = np.arange(len(row)) - first[row]
        grown = np.cumsum(np.log(weigh(several[at:stop][row], k)))
        odds = ways[size[row], k] + grown - (grown[first] - np.log(weigh(several[at:stop], 0)))[row] + rng.gumbel(size=len(row))
        best = np.flatnonzero(odds == np.maximum.reduceat(odds, first)[row])
        out[several[at:stop][row[best]]] = k[best] + 1
        at = stop
    many = np.flatnonzero(customers > EXACT)
    if len(many):
        out[many] = seat(customers[many], weigh(many, out[many]), discount, rng, EXACT, out[many])
    return out


def _discount(one: float, two: float) -> float:
    """From how many dishes were ordered once and twice, kept within 0.1 to 0.95."""
    return float(np.clip(one / (one + 2 * two), 0.1, 0.95)) if one else 0.5


def _packed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _numbers(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as hold the largest, the bytes of equal weight together, then compressed."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in range(4) if most < 1 << (8 << k))
    return bytes([kind]) + _packed(values.astype(_WHOLE[kind]).view(np.uint8).reshape(-1, 1 << kind).T.tobytes())


def _read_numbers(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data[1:]), np.uint8).reshape(1 << data[0], -1)
    return np.ascontiguousarray(planes.T).view(_WHOLE[data[0]]).ravel()


def _rising(keys: np.ndarray) -> bytes:
    """Sorted hashes as steps, the bytes of equal weight together."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return _packed(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def _read_rising(data: bytes) -> np.ndarray:
    planes = np.frombuffer(_unpacked(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Totals:
    """Sums over all buckets: tokens, words, pairs seen once and twice, then of the shared parent restaurant the dishes
    ordered once and twice, customers and tables."""

    def __init__(self, sums: np.ndarray) -> None:
        self.tokens, self.types, one, two, parent_one, parent_two, self.customers, self.tables = (float(x) for x in sums)
        self.discount, self.parent_discount = _discount(one, two), _discount(parent_one, parent_two)
        self.base = UNSEEN_MASS / max(1.0, self.types)


class Bucket:
    """The words of one range of hashes, their pairs with all contexts, and where each part's pairs are among them."""

    def __init__(self, rows: pa.Table) -> None:
        rows = sorted(rows.to_pylist(), key=lambda r: r["part"])
        self.bucket, self.parts = rows[0]["bucket"], [r["part"] for r in rows]
        named, before = ([_read_rising(r[c]) for r in rows] for c in ("words", "contexts"))
        counts = [_read_numbers(r["counts"]) for r in rows]
        self.words, of_word = np.unique(np.concatenate(named), return_inverse=True)
        self.contexts, of_context = np.unique(np.concatenate(before), return_inverse=True)
        ends, context_ends = (np.cumsum([len(x) for x in xs]) for xs in (named, before))
        self.part_words, many = [of_word[e - len(x):e] for e, x in zip(ends, named)], np.int64(max(1, len(self.contexts)))
        keys = np.concatenate([
            np.repeat(own * many, _read_numbers(r["sizes"])) + of_context[e - len(x):e][_read_numbers(r["at"])]
            for r, own, e, x in zip(rows, self.part_words, context_ends, before)])
        self.part_sizes = [len(c) for c in counts]
        self.part_ends = np.cumsum(self.part_sizes)
        order = np.argsort(keys, kind="stable")  # a part's keys rise, so runs are merged
        keys = keys[order]
        cuts = runs(keys)
        pairs, self.at = keys[cuts[:-1]], np.empty(len(keys), np.int64)
        self.at[order] = np.repeat(np.arange(len(pairs)), np.diff(cuts))
        self.word, self.context = np.divmod(pairs, many)
        self.count = np.bincount(self.at, np.concatenate(counts), minlength=len(pairs)).astype(np.int64)
        self.per_word = np.bincount(self.word, self.count, minlength=len(self.words)).astype(np.int64)
        self.used = np.flatnonzero(np.bincount(self.context[self.count > 0], minlength=len(self.contexts)))
        self.several = np.flatnonzero(self.count > 1)  # one customer always has one table

    def ordered(self, tables: np.ndarray) -> np.ndarray:
        """Customers of the parent: the word's tables in all contexts."""
        return np.bincount(self.word, tables, minlength=len(self.words)).astype(np.int64)

    def sums(self, tables: np.ndarray, parent: np.ndarray) -> np.ndarray:
        m = self.ordered(tables)
        return np.array([self.count.sum(), (self.per_word > 0).sum(), (self.count == 1).sum(), (self.count == 2).sum(),
                         (m == 1).sum(), (m == 2).sum(), m.sum(), parent.sum()], np.float64)

    def sweep(self, tables: np.ndarray, parent: np.ndarray, in_context: np.ndarray, totals: Totals, rng: np.random.Generator):
        """New tables of all pairs and, of each word, of the parent; ``in_context``: all tables of each context.

        A word's restaurants are visited in random order, the first 64 one by one, then in
        groups of an eighth of those visited. The visited seating is taken out first.
        """
        d, d0 = totals.discount, totals.parent_discount
        tables, parent, room, m = tables.copy(), parent.copy(), in_context.astype(np.float64), self.ordered(tables).astype(np.float64)
        mass0 = (PARENT_STRENGTH + d0 * totals.tables) * totals.base
        open_ = self.several
        open_ = open_[np.lexsort((rng.random(len(open_)), self.word[open_]))]
        cuts = runs(self.word[open_])
        place = np.arange(len(open_)) - np.repeat(cuts[:-1], np.diff(cuts))
        turn = np.where(place < 64, place, 64 + np.floor(np.log(np.maximum(place, 64) / 64) / np.log(1.125))).astype(np.int64)
        order = np.argsort(turn, kind="stable")
        turn, open_ = turn[order], open_[order]
        cuts = runs(turn)
        for s, e in zip(cuts[:-1], cuts[1:]):
            i = open_[s:e]
            w, u, own = self.word[i], self.context[i], tables[i].astype(np.float64)
            others, elsewhere = m[w] - own, room[u] - own
            mass = others - d0 * np.minimum(parent[w], others) + mass0
            strength = STRENGTH + d * elsewhere

            def weigh(rows, k):
                return (strength[rows] + d * k) * (mass[rows] + k) / (PARENT_STRENGTH + totals.customers + k)

            drawn = draw_tables(self.count[i], d, weigh, rng)
            np.add.at(m, w, drawn - own)
            np.add.at(room, u, drawn - own)
            tables[i] = drawn
        left = totals.tables - parent

        def weigh_parent(rows, k):
            return (PARENT_STRENGTH + d0 * (left[rows] + k)) * totals.base

        return tables, draw_tables(m.astype(np.int64), d0, weigh_parent, rng).astype(np.int64)


_ASKED = pa.schema([("bucket", pa.int64()), ("part", pa.int64()), ("words", pa.binary()), ("sizes", pa.binary()),
                    ("contexts", pa.binary()), ("at", pa.binary()), ("counts", pa.binary())])
_SENT = pa.schema([("bucket", pa.int64()), ("source", pa.int64()), ("names", pa.binary()), ("data", pa.binary()), ("totals", pa.binary())])
_TOLD = pa.schema([("part", pa.int64()), ("bucket", pa.int64()), ("pairs", pa.binary()), ("sums", pa.binary()), ("counts", pa.binary()),
                   ("ordered", pa.binary()), ("parent", pa.binary()), ("tables", pa.binary()), ("totals", pa.binary())])
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                     ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
#: The row that carries a bucket's own state.
_OWN = -1


def _kinds(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {({'int64': 'long', 'bool': 'boolean'}).get(str(f.type), str(f.type))}" for f in schema)


def _texts(rows: pa.Table) -> pa.Array:
    return pa.concat_arrays(rows["text"].chunks) if rows.num_rows else pa.array([], pa.string())


def _distinct_pairs(texts: pa.Array):
    """Sorted distinct words and starts; distinct pairs in the order of words, as word * size + context; each token's pair and text."""
    ids, before, text = token_pairs(texts)
    named, at = np.unique(np.append(ids, _START), return_inverse=True)
    last = np.where(before == _START, at[-1], np.roll(at[:-1], 1))
    keys = at[:-1] * np.int64(max(1, len(named))) + last
    pairs, of_token = np.unique(keys, return_inverse=True)
    return named, pairs, of_token, text


def _ask(buckets: int):
    def ask(rows: pa.Table) -> pa.Table:
        named, pairs, of_token, text = _distinct_pairs(_texts(rows))
        trains = ~rows["held_out"].to_numpy(zero_copy_only=False)[text]
        counts = np.bincount(of_token, trains, minlength=len(pairs)).astype(np.int64)
        word, context = np.divmod(pairs, max(1, len(named)))
        sizes, part = np.bincount(word, minlength=len(named)), rows["part"][0].as_py()
        at, ends, out = bucket_cuts(named, buckets), np.concatenate(([0], np.cumsum(sizes, dtype=np.int64))), []
        for b, (s, e) in enumerate(zip(at[:-1], at[1:])):  # a row for every bucket, so that each answers with its totals
            own = slice(ends[s], ends[e])
            used, place = np.unique(named[context[own]] & _CONTEXT, return_inverse=True)
            out.append((b, part, _rising(named[s:e]), _numbers(sizes[s:e]), _rising(used), _numbers(place), _numbers(counts[own])))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out), _ASKED)], schema=_ASKED)

    return ask


def _send(own: Bucket, state: dict, buckets: int, first: bool = False) -> pa.Table:
    """Tables of the contexts that training pairs have, to the buckets that own them; ``first`` with their names."""
    keys = own.contexts[own.used]
    mine = np.bincount(own.context, state["tables"], minlength=len(own.contexts))[own.used].astype(np.int64)
    at = bucket_cuts(keys, buckets)
    cells, sums = list(zip(at[:-1], at[1:])), own.sums(state["tables"], state["parent"]).tobytes()
    kept = {**state, **{c: _numbers(state[c][own.several]) for c in ("tables", "sum")}, "parent": _numbers(state["parent"])}
    return pa.table([pa.array([*range(buckets), own.bucket], pa.int64()), pa.array([own.bucket] * buckets + [_OWN], pa.int64()),
                     pa.array([*(_rising(keys[s:e]) if first else b"" for s, e in cells), b""], pa.binary()),
                     pa.array([*(_numbers(mine[s:e]) for s, e in cells), pickle.dumps(kept)], pa.binary()),
                     pa.array([sums] * (buckets + 1), pa.binary())], schema=_SENT)


def _open(buckets: int):
    def start(rows: pa.Table) -> pa.Table:
        """Every word has one table in each of its contexts, and one in the parent."""
        own = Bucket(rows)
        tables, parent = (own.count > 0).astype(np.int64), (own.per_word > 0).astype(np.int64)
        return _send(own, {"tables": tables, "parent": parent, "sum": np.zeros(len(tables), np.int64), "discount": 0.5, "kept": [], "sums": [], "rooms": []}, buckets, True)

    return start


def _add(keep: bool):
    def add(names: pa.Table, sent: pa.Table) -> pa.Table:
        """All tables of the contexts a bucket owns, to all that asked; and the sums over all buckets."""
        rows = {r["source"]: r for r in sent.to_pylist()}
        named = sorted(((r["source"], _read_rising(r["names"])) for r in names.to_pylist() if r["source"] != _OWN), key=lambda r: r[0])
        keys, at = np.unique(np.concatenate([k for _, k in named]), return_inverse=True)
        mine = np.concatenate([_read_numbers(rows[b]["data"]).astype(np.int64) for b, _ in named])
        whole = np.bincount(at, mine, minlength=len(keys)).astype(np.int64)
        sums = np.sum([np.frombuffer(rows[b]["totals"], np.float64) for b, _ in named], axis=0).tobytes()
        bucket, state, ends = sent["bucket"][0].as_py(), pickle.loads(rows[_OWN]["data"]), np.cumsum([len(k) for _, k in named])
        if keep:
            state["owned"] = _rising(keys)
            state["rooms"] = [*state["rooms"], _numbers(whole)]
        return pa.table([pa.array([*(b for b, _ in named), bucket], pa.int64()), pa.array([bucket] * len(named) + [_OWN], pa.int64()),
                         pa.array([b""] * (len(named) + 1), pa.binary()),
                         pa.array([*(_numbers(whole[at[e - len(k):e]]) for e, (_, k) in zip(ends, named)), pickle.dumps(state)], pa.binary()),
                         pa.array([sums] * (len(named) + 1), pa.binary())], schema=_SENT)

    return add


def _received(rows: pa.Table, sent: pa.Table) -> tuple[Bucket, dict, dict, Totals]:
    own, got = Bucket(rows), {r["source"]: r for r in sent.to_pylist()}
    state, totals = pickle.loads(got[_OWN]["data"]), Totals(np.frombuffer(got[_OWN]["totals"], np.float64))
    seen, samples = own.count > 0, max(0, len(state["rooms"]))
    for c, each in (("tables", 1), ("sum", samples)):
        several, state[c] = _read_numbers(state[c]), np.where(seen, each, 0)
        state[c][own.several] = several
    state["parent"] = _read_numbers(state["parent"]).astype(np.int64)
    if len(state["kept"]) < len(state["rooms"]):  # the last sweep's seating is a sample
        state["kept"] = [*state["kept"], (_numbers(own.ordered(state["tables"])), _numbers(state["parent"]))]
        state["sums"] = [*state["sums"], np.array([state["discount"], totals.customers, totals.tables])]
    return own, got, state, totals


def _sweep(buckets: int, number: int):
    def sweep(rows: pa.Table, sent: pa.Table) -> pa.Table:
        own, got, state, totals = _received(rows, sent)
        room = np.zeros(len(own.contexts))
        room[own.used] = np.concatenate([_read_numbers(got[b]["data"]) for b in range(buckets)])
        tables, parent = own.sweep(state["tables"], state["parent"], room, totals, np.random.default_rng([number, own.bucket]))
        state.update(tables=tables, parent=parent, discount=totals.parent_discount)
        if number >= BURN_IN:
            state["sum"] = state["sum"] + tables
        return _send(own, state, buckets)

    return sweep


def _answer(rows: pa.Table, sent: pa.Table) -> pa.Table:
    own, got, state, totals = _received(rows, sent)
    at, rooms = np.searchsorted(_read_rising(state["owned"]), own.words & _CONTEXT), [_read_numbers(x) for x in state["rooms"]]
    owned = np.isin(own.words & _CONTEXT, _read_rising(state["owned"]))
    rooms = [np.where(owned, np.append(x, 0)[at], 0).astype(np.int64) for x in rooms]
    ordered, parent = ([_read_numbers(x) for x in xs] for xs in zip(*state["kept"]))
    mine = [own.at[e - n:e] for e, n in zip(own.part_ends, own.part_sizes)]
    return pa.table([
        pa.array(own.parts, pa.int64()), pa.array([own.bucket] * len(own.parts), pa.int64()),
        pa.array([_numbers(own.count[a]) for a in mine], pa.binary()),
        pa.array([_numbers(state["sum"][a]) for a in mine], pa.binary()),
        pa.array([_numbers(own.per_word[w]) for w in own.part_words], pa.binary()),
        pa.array([_numbers(np.concatenate([x[w] for x in ordered])) for w in own.part_words], pa.binary()),
        pa.array([_numbers(np.concatenate([x[w] for x in parent])) for w in own.part_words], pa.binary()),
        pa.array([_numbers(np.concatenate([x[w] for x in rooms])) for w in own.part_words], pa.binary()),
        pa.array([got[_OWN]["totals"] + np.concatenate(state["sums"]).tobytes()] * len(own.parts), pa.binary())], schema=_TOLD)


def _score(left: pa.Table, right: pa.Table) -> pa.Table:
    n = left.num_rows
    if not n:
        return _SCORED.empty_table()
    named, pairs, of_token, text = _distinct_pairs(_texts(left))
    told = sorted(right.to_pylist(), key=lambda r: r["bucket"])
    kept, sent = SWEEPS - BURN_IN, np.frombuffer(told[0]["totals"], np.float64)
    totals = Totals(sent[:-3 * kept])
    ordered, parent, room = (np.concatenate([_read_numbers(r[c]).reshape(kept, -1).astype(np.float64) for r in told], axis=1)
                             for c in ("ordered", "parent", "tables"))
    of_pair, sums, counts = (np.concatenate([_read_numbers(r[c]).astype(np.float64) for r in told]) for c in ("pairs", "sums", "counts"))
    in_context = of_pair - totals.discount * sums / kept
    w, u = np.divmod(pairs, len(named))
    customers = np.where(named == _START, counts[named == _END], counts)  # a word is followed as often as it occurs
    p = in_context
    base = np.where(counts > 0, totals.base, 1 - UNSEEN_MASS)
    for m, s, tables, (d0, all_m, all_s) in zip(ordered, parent, room, sent[-3 * kept:].reshape(kept, 3)):
        p0 = (m - d0 * s + (PARENT_STRENGTH + d0 * all_s) * base) / (PARENT_STRENGTH + all_m)
        p += (STRENGTH + totals.discount * tables[u]) * p0[w] / kept  # probabilities are averaged over the samples
    p /= STRENGTH + customers[u]
    plain = np.log10((counts + 0.1) / (totals.tokens + 0.1 * (totals.types + 1)))

    def per_text(values):
        return np.bincount(text, values[of_token], minlength=n)

    return pa.table([
        left["doc_id"], left["held_out"], pa.array(np.bincount(text, minlength=n)),
        pa.array(per_text(counts[w] > 0).astype(np.int64)), pa.array(np.full(n, int(totals.tokens))),
        pa.array(per_text(plain[w])), pa.array(per_text(np.log10(p)))], schema=_SCORED)


def score_texts(docs: DataFrame, held_out: Column, doc_id: str = "doc_id", text: str = "text",
                part_bytes: int = PART_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score): one row per row of ``docs``.

    The model learns from the rows where ``held_out`` is false or null and scores all.
    ``score`` is its log10 probability of the whole text and the end; ``base_score`` that
    of add-0.1 unigrams. A word the training rows lack has the unseen mass. Null and empty
    texts are the end token alone. Repeated rows count and are scored each; other columns
    are not carried; no rows give no rows, and with no training rows all words are unseen.
    """
    own = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"),
                      F.coalesce(held_out, F.lit(False)).alias("held_out"))
    size = F.octet_length("text") + 64
    total = own.agg(F.sum(size.cast("long")).alias("s")).first()["s"] or 0
    parts, buckets = max(1, -(-total // part_bytes)), max(1, -(-total // bucket_bytes))
    dealt = own.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long")).repartition(parts, "part")
    asked = dealt.groupBy("part").applyInArrow(_ask(buckets), _kinds(_ASKED)).groupBy("bucket")
    names = asked.applyInArrow(_open(buckets), _kinds(_SENT)).groupBy("bucket")
    first = _add(False)
    totals = names.applyInArrow(lambda rows: first(rows, rows), _kinds(_SENT))
    for number in range(SWEEPS):
        if number:
            totals = names.cogroup(sent.groupBy("bucket")).applyInArrow(_add(number > BURN_IN), _kinds(_SENT))
        sent = asked.cogroup(totals.groupBy("bucket")).applyInArrow(_sweep(buckets, number), _kinds(_SENT))
    totals = names.cogroup(sent.groupBy("bucket")).applyInArrow(_add(True), _kinds(_SENT))
    told = asked.cogroup(totals.groupBy("bucket")).applyInArrow(_answer, _kinds(_TOLD))
    return dealt.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(
        _score, _kinds(_SCORED))


def op6_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return score_texts(docs, F.crc32(F.col("doc_id").cast("string")) % 10 == 0)


QUERIES = {"op6_lm_scoring": op6_lm_scoring}
ORACLES: dict[str, str] = {}
