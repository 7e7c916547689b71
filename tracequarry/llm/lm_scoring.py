"""Language-model scoring with a small causal self-attention model, trained here in numpy.

Texts are read as subword ids of a public tokenizer. Word and subword counts, counts of pairs of neighbouring subwords
and the model's training windows come from all of every training document: each id and end is to be foretold once in each epoch.
The model (one attention layer, one feed-forward layer, a two-step softmax over the corpus's most frequent subwords) is
trained by averaging: in every round, tasks go on from the same model over their own windows, and Spark averages what
they have, by levels. A subword outside of the model's costs the model's chance of a rare one times its share of the
corpus's rare counts.

A word's chance is a mixture of its share of the corpus's words, of the
attention model's chance that the next word is spelled so: the product over its subwords, of which
the first is known to start a word, and of the chance that the word ends there; and of the same product by
counts of pairs of neighbouring subwords of the model. Each is a
distribution over all words, so the score is a true log-probability.

A text is scored whole, in overlapping context windows: each window sees OVERLAP ids that
an earlier one has scored, and every id is scored once. Windows of many texts go through batched masked attention together.

Each task cuts its rows into blocks of about BLOCK_BYTES of text, in the order in which they come, so no key decides
where a row goes. A block is written once, as word numbers and subword ids; its distinct words get the
corpus's counts by one window over all blocks' words and come back to the block, so text is never shuffled, and no count
table that grows with the corpus is ever broadcast.

Defined results: a null text is empty, which is the end alone; rows that repeat are scored each; a null id is in
training; without any training token every word is unknown and the
model is uniform; other columns are ignored, whatever their names; an empty table gives an empty result.
"""

import base64
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of_id, give_back, holding_memory, small_batches, staged

FOLDS, HELD_OUT = 7, 2
#: Text of a block; only one text alone has more. The word rows of the corpus are those of all blocks.
BLOCK_BYTES = 12 << 20
#: Context of a window, and how much of it an earlier window has scored.
CONTEXT, OVERLAP = 32, 8
STEP = CONTEXT - OVERLAP
#: Classes of the softmax and members of each. The first STARTS classes hold what starts a word: the end (id END), a
#: rare start (RARE_START) and subwords led by a space; the others hold a rare continuation (RARE_ON) and continuations.
CLASSES, MEMBERS, STARTS = 32, 32, 12
IDS = CLASSES * MEMBERS
END, RARE_START, RARE_ON = 0, 1, STARTS * MEMBERS
WIDTH, HIDDEN = 32, 64
#: The corpus's word counts have this part in a word's chance; of the rest the pair counts have PAIRS, wherever a word
#: has followed the last subword in training, and the attention model what is left.
MIX, PAIRS = 0.15, 0.4
#: A small corpus is gone over up to EPOCHS times, for about EPOCHS * LEAST_WINDOWS windows in all, any other once. WINDOW_IDS is for training_windows() only.
WINDOW_IDS, LEAST_WINDOWS, EPOCHS = 1024, 24_000, 6
#: Times that models are averaged at least, and models averaged by one task.
ROUNDS, FAN = 4, 16
SEED = 3
BATCH = 64
#: Rows of a class that the gradient multiplies together.
BLOCK_ROWS = 32
#: Windows that go through attention, and through the softmax, together; ids of texts scored at once.
SCORE_BATCH, SOFTMAX_BATCH, SCORE_IDS = 128, 512, 100_000


def words_of(text: str | None) -> list[bytes]:
    """Words in order: bytes know ASCII white space and case only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def word_lists(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words in a row, words of each text) as words_of has them; a null has none."""
    plain = pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lists = pc.ascii_split_whitespace(plain)
    words = lists.flatten()
    n = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    n[pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)] = 0
    return words.filter(pc.greater(pc.binary_length(words), 0)), n


class Subwords:
    """Ids of words by a byte-level BPE, each word led by a space."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.size = max(ranks.values()) + 1
        if self.size >= 1 << 16:
            raise ValueError("ids are kept in 16 bits")
        self.leads = np.zeros(self.size, bool)
        self.leads[[i for b, i in ranks.items() if b.startswith(b" ")]] = True
        coding = tiktoken.Encoding("subwords", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = coding.encode_ordinary
        self.encode_array = lambda text: coding.encode_to_numpy(text, disallowed_special=())

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, where each word's ids start and the last ends); each word is encoded by itself."""
        parts = [self.encode_array(" " + " ".join(words[i : i + 50_000])) for i in range(0, len(words), 50_000)]
        ids = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
        first = np.flatnonzero(self.leads[ids])
        if len(first) != len(words):  # words that are other white space join their neighbours
            parts = [self.encode(" " + w) for w in words]
            ids = np.array([x for p in parts for x in p], np.int32)
            first = np.cumsum([0] + [len(p) for p in parts])[:-1]
        return ids, np.append(first, len(ids))


def gathered(ids: np.ndarray, bounds: np.ndarray, words: np.ndarray, each: int = 1 << 18) -> np.ndarray:
    """The ids of words, given by number, in a row; worked out for `each` words at a time."""
    size = np.diff(bounds)
    out, at = np.empty(int(size[words].sum()), ids.dtype), 0
    for i in range(0, len(words), each):
        some = words[i : i + each]
        n = size[some]
        ends = np.cumsum(n)
        out[at : at + ends[-1]] = ids[np.arange(ends[-1]) + np.repeat(bounds[some] - ends + n, n)]
        at += ends[-1]
    return out


# --- the model ------------------------------------------------------------------------------


def new_model(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale=0.1):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    return {
        "embed": normal(CLASSES * MEMBERS, WIDTH, scale=0.3), "far": np.zeros(CONTEXT, np.float32),
        "q": normal(WIDTH, WIDTH, scale=0.2), "k": normal(WIDTH, WIDTH, scale=0.2), "v": normal(WIDTH, WIDTH),
        "w1": normal(WIDTH, HIDDEN, scale=0.2), "b1": np.zeros(HIDDEN, np.float32), "w2": normal(HIDDEN, WIDTH),
        "cls": normal(WIDTH, CLASSES), "cls_b": np.zeros(CLASSES, np.float32),
        "mem": normal(CLASSES, WIDTH, MEMBERS), "mem_b": np.zeros((CLASSES, MEMBERS), np.float32),
    }


def _rms(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).reshape(-1, WIDTH) @ np.full(WIDTH, 1 / WIDTH, x.dtype)
    square += x.dtype.type(1e-5)
    scale = (1 / np.sqrt(square, out=square)).reshape(*x.shape[:-1], 1)
    return x * scale, scale


def _rms_back(dy: np.ndarray, y: np.ndarray, scale: np.ndarray) -> np.ndarray:
    out = dy * y
    np.multiply(y, (out @ np.full(WIDTH, -1 / WIDTH, out.dtype))[:, None], out=out)
    out += dy
    out *= scale
    return out


def _distance(t: int) -> np.ndarray:
    """How far back each place is from each other, 0 where it is not."""
    return np.maximum(np.arange(t)[:, None] - np.arange(t)[None, :], 0)


_DISTANCE, _TRI = _distance(CONTEXT), np.tri(CONTEXT, dtype=np.float32)


def _forward(m: dict, ids: np.ndarray) -> dict:
    """Hidden states after each id of a (windows, length) batch, and what the gradient needs.

    Queries, keys and values depend on the id only, so they are worked out once for each different id of the batch.
    """
    n, t = ids.shape
    read = ids.reshape(-1)
    times = np.bincount(read, minlength=IDS)
    several = np.flatnonzero(times)
    e = np.take(m["embed"], several, axis=0)
    y, ys = _rms(e)
    qkv = np.concatenate([m["q"] * np.float32(WIDTH**-0.5), m["k"], m["v"]], axis=1)
    rows = np.take(np.concatenate([y @ qkv, e], axis=1), np.take(np.cumsum(times > 0) - 1, read), axis=0).reshape(n, t, 4 * WIDTH)
    q, k, v, x = (rows[..., i * WIDTH : (i + 1) * WIDTH] for i in range(4))
    a = np.matmul(q, k.transpose(0, 2, 1))
    if a.max() > 40:
        np.minimum(a, 40, out=a)
    np.exp(a, out=a)
    a *= np.exp(m["far"])[_DISTANCE[:t, :t]] * _TRI[:t, :t]  # no id sees a later one
    a *= 1 / (a @ np.ones((t, 1), a.dtype))
    x1 = np.matmul(a, v)
    x1 += x
    y1, y1s = _rms(x1)
    h = y1.reshape(-1, WIDTH) @ m["w1"]
    h += m["b1"]
    np.maximum(h, np.zeros((1, HIDDEN), h.dtype), out=h)  # faster than with a number
    x1 += (h @ m["w2"]).reshape(x1.shape)
    out, zs = _rms(x1)
    return {"several": several, "times": times, "y": y, "ys": ys, "qkv": qkv, "q": q, "k": k, "v": v, "a": a, "y1": y1, "y1s": y1s, "h": h, "out": out, "zs": zs}


def tables(m: dict) -> dict:
    """What scoring looks up for each model id: its query, key, value with a 1 for the sum, and embedding.

    Places enter by their distance alone, so these depend on the id only.
    """
    y, _ = _rms(m["embed"])
    q, k = y @ m["q"] * np.float32(WIDTH**-0.5), y @ m["k"]
    v = np.concatenate([y @ m["v"], np.ones((len(y), 1), np.float32)], axis=1)
    most = float(np.linalg.norm(q, axis=1).max() * np.linalg.norm(k, axis=1).max())
    # A hidden state is as long as the root of WIDTH at most, so no logit is greater than this.
    logit = WIDTH**0.5 * max(float(np.linalg.norm(m["cls"], axis=0).max()), float(np.linalg.norm(m["mem"], axis=1).max())) + float(max(np.abs(m["cls_b"]).max(), np.abs(m["mem_b"]).max()))
    sums = np.stack([np.ones(CLASSES), np.arange(CLASSES) < STARTS], axis=1).astype(np.float32)
    return m | {"looked_up": np.concatenate([q, k, v, m["embed"]], axis=1), "decay": np.exp(m["far"])[_distance(CONTEXT)] * np.tri(CONTEXT, dtype=np.float32), "clip": most > 40, "clip_logits": logit > 80, "sums": sums}


def _attended(m: dict, q: np.ndarray, k: np.ndarray, v: np.ndarray, own: np.ndarray, decay: np.ndarray) -> np.ndarray:
    """Hidden states of (windows, places) queries over their windows' keys and values; own: the embeddings of these places."""
    a = np.matmul(q, k.transpose(0, 2, 1))
    if m["clip"]:
        np.minimum(a, 40, out=a)
    np.exp(a, out=a)
    a *= decay
    c = np.matmul(a, v).reshape(-1, WIDTH + 1)
    x1 = c[:, :WIDTH] * (1 / c[:, WIDTH:])
    x1 += own
    h = _rms(x1)[0] @ m["w1"]
    h += m["b1"]
    np.maximum(h, np.zeros((1, HIDDEN), h.dtype), out=h)  # faster than with a number
    x1 += h @ m["w2"]
    return _rms(x1)[0]


def _columns(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Queries, keys, values and embeddings among what tables() has of each id."""
    return rows[..., :WIDTH], rows[..., WIDTH : 2 * WIDTH], rows[..., 2 * WIDTH : 3 * WIDTH + 1], rows[..., 3 * WIDTH + 1 :]


def _windows(x: np.ndarray, first: int, n: int, size: int) -> np.ndarray:
    """Rows first + STEP * i to first + STEP * i + size of x for n numbers i, without a copy."""
    return np.lib.stride_tricks.as_strided(x[first:], (n, size, x.shape[1]), (STEP * x.strides[0], *x.strides), writeable=False)


def hidden_states(m: dict, stream: np.ndarray, heads: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(place, hidden states after the ids from there on) of a stream of texts, each padded to whole STEPs; SOFTMAX_BATCH windows at a time.

    stream: model ids; heads: where texts start, in order. Windows start every STEP ids and see CONTEXT; of all but a
    text's first, the first OVERLAP ids were scored by the one before.
    """
    n, carried = len(stream) // STEP, np.empty((OVERLAP, WIDTH), np.float32)
    stream = np.append(stream, np.zeros(OVERLAP, stream.dtype))
    for at in range(0, n, SOFTMAX_BATCH):
        many, place = min(SOFTMAX_BATCH, n - at), at * STEP
        out = np.empty((many * STEP + OVERLAP, WIDTH), np.float32)
        out[:OVERLAP] = carried
        for begin in range(0, many, SCORE_BATCH):
            w, a = min(SCORE_BATCH, many - begin), begin * STEP
            ids = stream[place + a : place + a + w * STEP + OVERLAP]
            q, k, v, own = _columns(np.take(m["looked_up"], ids, axis=0))
            out[a + OVERLAP : a + OVERLAP + w * STEP] = _attended(m, _windows(q, OVERLAP, w, STEP), _windows(k, 0, w, CONTEXT), _windows(v, 0, w, CONTEXT), own[OVERLAP:], m["decay"][OVERLAP:])
        carried = out[-OVERLAP:].copy()
        first = heads[np.searchsorted(heads, place) : np.searchsorted(heads, place + many * STEP)]
        if len(first):  # texts' first ids see none of the text before
            span = (first - place)[:, None] + np.arange(OVERLAP)
            ids = stream[span + place]
            q, k, v, own = _columns(np.take(m["looked_up"], ids, axis=0))
            out[span.reshape(-1)] = _attended(m, q, k, v, own.reshape(-1, WIDTH), m["decay"][:OVERLAP, :OVERLAP])
        yield place, out[: many * STEP]


def _softmax(logits: np.ndarray) -> np.ndarray:
    if logits.max() > 80:
        np.minimum(logits, 80, out=logits)
    np.exp(logits, out=logits)
    logits *= 1 / (logits @ np.ones((logits.shape[1], 1), logits.dtype))
    return logits


def log_chances(m: dict, hidden: np.ndarray, rows: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log of the chance of each target id after the hidden state in its row, log of the chance that a word starts there)."""
    cls = target // MEMBERS
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    ordered, target = np.take(hidden, np.take(rows, order), axis=0), np.take(target, order)
    ends = np.searchsorted(np.take(cls, order), np.arange(CLASSES + 1))
    e = _exponents(ordered @ m["cls"], m["cls_b"], m["clip_logits"])
    sums = e @ m["sums"]
    chance = np.take(e.reshape(-1), np.arange(0, len(target) * CLASSES, CLASSES) + target // MEMBERS) / sums[:, 0]
    member, ones = target % MEMBERS, m["sums"][:, 0]
    for g in range(CLASSES):
        a, b = ends[g], ends[g + 1]
        if a < b:
            e = _exponents(ordered[a:b] @ m["mem"][g], m["mem_b"][g], m["clip_logits"])
            chance[a:b] *= np.take(e.reshape(-1), np.arange(0, (b - a) * MEMBERS, MEMBERS) + member[a:b]) / (e @ ones)
    log, start = np.empty(len(target), np.float32), np.empty(len(target), np.float32)
    log[order], start[order] = np.log(chance + np.float32(1e-20)), np.log(sums[:, 1] / sums[:, 0] + np.float32(1e-12))
    return log, start


def _exponents(logits: np.ndarray, bias: np.ndarray, clip: bool) -> np.ndarray:
    logits += bias
    if clip:
        np.minimum(logits, 80, out=logits)
    return np.exp(logits, out=logits)


def _runs(times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which small numbers occur, how often each, where each begins in order), of how often every one does."""
    several = np.flatnonzero(times)
    n = np.take(times, several)
    return several, n, np.cumsum(n) - n


def _sums(rows: np.ndarray, order: np.ndarray, times: np.ndarray, many: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(which small numbers occur, the sum of each one's rows); order: the rows by number, times: how often every number occurs.

    Rows of numbers that occur more than `many` times are added up number by number, the others' first, second, ... rows together.
    """
    several, n, begins = _runs(times)
    most = np.argsort(-n, kind="stable")
    several, n, begins = several[most], n[most], begins[most]
    out, ones = np.take(rows, order[begins], axis=0), np.ones(n[0], rows.dtype)
    more = len(n) - np.cumsum(np.bincount(n, minlength=many + 1))  # numbers that occur more often than 0, 1, ... times
    for i, (a, k) in enumerate(zip(begins[: more[many]].tolist(), n.tolist())):
        np.matmul(ones[:k], np.take(rows, order[a : a + k], axis=0), out=out[i])
    for k in range(1, many):
        some = slice(more[many], more[k])
        out[some] += np.take(rows, order[begins[some] + k], axis=0)
    return several, out


def _gradient(m: dict, ids: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
    """Mean loss of a batch without padding, and its gradient.

    Members' softmaxes are worked out for all classes together. What goes back to queries, keys, values and embeddings is
    added up for each different id first, as these depend on the id only.
    """
    f, g = _forward(m, ids), {"far": np.zeros_like(m["far"])}
    n, t = ids.shape
    flat, read, want = f["out"].reshape(-1, WIDTH), ids.reshape(-1), target.reshape(-1)
    share, ones = np.float32(1 / (n * t)), np.ones(len(want), flat.dtype)
    places = np.arange(len(want))
    # Rows in the order of what is to come, so of its classes.
    order = np.argsort(want.astype(np.uint16), kind="stable")
    want, hidden = np.take(want, order), np.take(flat, order, axis=0)
    cls, mem = want // MEMBERS, want % MEMBERS
    p = hidden @ m["cls"]
    p += m["cls_b"]
    _softmax(p)
    own = places * CLASSES + cls
    found = np.take(p.reshape(-1), own)
    loss = -share * np.log(found + 1e-12).sum()
    p.reshape(-1)[own] = found - 1
    p *= share
    g["cls"], g["cls_b"] = hidden.T @ p, ones @ p
    d = p @ m["cls"].T
    # Each class padded to whole blocks of BLOCK_ROWS.
    several, n_own, begins = _runs(np.bincount(cls))
    n_blocks = -(-n_own // BLOCK_ROWS)
    first = np.cumsum(n_blocks) - n_blocks
    of_block = np.repeat(several, n_blocks)
    slot = places + np.repeat(first * BLOCK_ROWS - begins, n_own)
    members = np.take(m["mem"], of_block, axis=0)
    padded, weight = np.zeros((len(members) * BLOCK_ROWS, WIDTH), d.dtype), np.zeros((len(members) * BLOCK_ROWS, 1), d.dtype)
    padded[slot], weight[slot] = hidden, share
    padded = padded.reshape(-1, BLOCK_ROWS, WIDTH)
    blocks = np.matmul(padded, members)
    blocks += np.take(m["mem_b"], of_block, axis=0)[:, None]
    p = _softmax(blocks.reshape(-1, MEMBERS))
    own = slot * MEMBERS + mem
    found = np.take(p.reshape(-1), own)
    loss -= share * np.log(found + 1e-12).sum()
    p.reshape(-1)[own] = found - 1
    p *= weight
    g["mem"], g["mem_b"] = np.zeros_like(m["mem"]), np.zeros_like(m["mem_b"])
    g["mem_b"][several] = np.add.reduceat(np.ones(BLOCK_ROWS, d.dtype) @ blocks, first, axis=0)
    rows = padded.reshape(-1, WIDTH)
    for c, a, b in zip(several, first * BLOCK_ROWS, first * BLOCK_ROWS + n_own, strict=True):
        np.matmul(rows[a:b].T, p[a:b], out=g["mem"][c])
    d += np.take(np.matmul(blocks, members.transpose(0, 2, 1)).reshape(-1, WIDTH), slot, axis=0)
    hidden[order] = d
    dz = _rms_back(hidden, flat, f["zs"].reshape(-1, 1))
    g["w2"] = f["h"].T @ dz
    dh = dz @ m["w2"].T
    dh *= f["h"] > 0
    y1 = f["y1"].reshape(-1, WIDTH)
    g["w1"], g["b1"] = y1.T @ dh, ones @ dh
    dx = _rms_back(dh @ m["w1"].T, y1, f["y1s"].reshape(-1, 1))
    dx += dz
    back = np.empty((n, t, 4 * WIDTH), dx.dtype)  # to queries, keys, values and embeddings
    back[..., 3 * WIDTH :] = dx1 = dx.reshape(n, t, WIDTH)
    ds = np.matmul(dx1, f["v"].transpose(0, 2, 1))
    np.matmul(f["a"].transpose(0, 2, 1), dx1, out=back[..., 2 * WIDTH : 3 * WIDTH])
    ds -= np.einsum("nij,nij->ni", ds, f["a"])[..., None]
    ds *= f["a"]
    g["far"][:t] = np.bincount(_DISTANCE[:t, :t].reshape(-1), weights=(np.ones(n, ds.dtype) @ ds.reshape(n, -1)), minlength=t)
    np.matmul(ds, f["k"], out=back[..., :WIDTH])
    np.matmul(ds.transpose(0, 2, 1), f["q"], out=back[..., WIDTH : 2 * WIDTH])
    several, sums = _sums(back.reshape(-1, 4 * WIDTH), np.argsort(read.astype(np.uint16), kind="stable"), f["times"])
    both, at = sums[:, : 3 * WIDTH], np.searchsorted(f["several"], several)
    y, ys = f["y"][at], f["ys"][at]
    g["q"], g["k"], g["v"] = np.split(y.T @ both, 3, axis=1)
    g["q"] = g["q"] * np.float32(WIDTH**-0.5)
    g["embed"] = np.zeros_like(m["embed"])
    g["embed"][several] = sums[:, 3 * WIDTH :] + _rms_back(both @ f["qkv"].T, y, ys)
    return float(loss), {k: g[k] for k in m}


def started_model(unigram: np.ndarray, seed: int = SEED) -> dict[str, np.ndarray]:
    """A model before training; unigram: chances of all ids, where biases start."""
    m, by_class = new_model(seed), unigram.reshape(CLASSES, MEMBERS)
    return m | {"mem_b": np.log(by_class + 1e-9).astype(np.float32), "cls_b": np.log(by_class.sum(axis=1) + 1e-9).astype(np.float32)}


def trained(m: dict, windows: np.ndarray, begun: float, ended: float, seed: int = SEED) -> dict:
    """m after Adam over (windows, CONTEXT + 1) ids once; begun, ended: the part of all training before and after it."""
    held = packed(m)
    m, first, second, room = unpacked(held), np.zeros_like(held), np.zeros_like(held), np.empty_like(held)
    order = np.random.default_rng(seed).permutation(len(windows))
    steps = -(-len(order) // BATCH)
    for step, at in enumerate(range(0, len(order), BATCH), 1):
        batch = windows[order[at : at + BATCH]]
        g = packed(_gradient(m, batch[:, :-1], batch[:, 1:])[1])
        done = begun + (ended - begun) * step / steps
        rate = 6e-3 * min(1.0, step / 50 + (begun > 0)) * (1 - 0.95 * done)
        first += np.multiply(np.subtract(g, first, out=room), 0.1, out=room)
        g *= g
        second += np.multiply(np.subtract(g, second, out=room), 0.02, out=room)
        np.sqrt(np.multiply(second, 1 / (1 - 0.98**step), out=room), out=room)
        room += 1e-8
        np.divide(first, room, out=room)
        room *= rate / (1 - 0.9**step)
        held -= room
    return m


def packed(m: dict) -> np.ndarray:
    return np.concatenate([v.reshape(-1) for v in m.values()])


def unpacked(values: np.ndarray) -> dict[str, np.ndarray]:
    """A model of float32; it is a view of values where these are so."""
    out, at = {}, 0
    for k, v in new_model().items():
        out[k], at = values[at : at + v.size].reshape(v.shape).astype(np.float32, copy=False), at + v.size
    return out


def windows_of(n: int) -> np.ndarray:
    """(start, end, first scored) rows of windows over n ids: each is scored once, with OVERLAP ids before it at least."""
    first = np.concatenate([[0], np.arange(CONTEXT, n, STEP)])[: n > 0 and None]
    start = np.maximum(0, first - OVERLAP)
    return np.stack([start, np.minimum(n, start + CONTEXT), first], axis=1)


def pair_chances(before: np.ndarray, target: np.ndarray, share: np.ndarray, first: np.ndarray, learnt: dict) -> tuple[np.ndarray, np.ndarray]:
    """(chance of each word and end by pair counts, their part in it).

    before, target: model ids of a stream and what follows each; share: of a rare target in its kind, else 1; first: where words and
    ends start in target; learnt: `pairs`, how often each id followed each, as shares, and `begins`, that of ids that start a word.
    """
    p = (np.take(learnt["pairs"].reshape(-1), before * IDS + target) * share).astype(np.float64)
    begins = np.take(learnt["begins"], before[first]).astype(np.float64)
    p[first] = np.where(begins > 0, p[first] / np.where(begins > 0, begins, 1), 0)  # that a word starts here is no news
    chance = np.multiply.reduceat(p, first)
    chance[:-1] *= np.where(target[first[:-1]] == END, 1, begins[1:])  # that a word ends where the next one starts is
    return chance, np.where(begins > 0, PAIRS, 0.0)


def scores(learnt: dict, ids: np.ndarray, sizes: np.ndarray, firsts: np.ndarray, shares: np.ndarray, words: np.ndarray) -> np.ndarray:
    """log10 chance of each text's words and end.

    learnt: as learn() gives it; ids: the texts' subword ids in a row; sizes: ids of each text; firsts: which ids
    start a word; shares: of each word in the corpus, each text's followed by that of the end; words: words of each text.
    """
    m, known = learnt["tables"], learnt["known"]
    # What is read: each text led by an end, padded; what is to come: its ids and its own end.
    length = sizes + 1
    room = -(-length // STEP) * STEP
    heads = np.cumsum(room) - room
    place = np.arange(length.sum()) + np.repeat(heads - np.cumsum(length) + length, length)
    inner = np.ones(len(place), bool)
    inner[np.cumsum(length) - 1] = False
    target, starts, rare = np.full(len(place), END, np.int32), np.ones(len(place), bool), np.zeros(len(place), np.float32)
    target[inner], starts[inner], rare[inner] = known[ids], firsts, learnt["rare_log"][ids]
    stream = np.full(room.sum(), END, np.int32)
    stream[place[inner] + 1] = target[inner]
    found, begins = np.empty(len(place), np.float32), np.empty(len(place), np.float32)
    for at, hidden in hidden_states(m, stream, heads):
        a, b = np.searchsorted(place, (at, at + len(hidden)))
        found[a:b], begins[a:b] = log_chances(m, hidden, place[a:b] - at, target[a:b])
    first = np.flatnonzero(starts)
    spelled = np.add.reduceat((found + rare).astype(np.float64), first)
    begins = begins[first]
    spelled -= begins  # that a word starts here is no news
    last = target[first] == END
    spelled[:-1] += np.where(last[:-1], 0, begins[1:])  # that it ends where the next one starts is
    pair, part = pair_chances(stream[place], target, np.exp(rare), first, learnt)
    chance = np.log(MIX * shares + (1 - MIX) * ((1 - part) * np.exp(spelled) + part * pair))
    return np.add.reduceat(chance, np.cumsum(words + 1) - words - 1) / np.log(10)


# --- the corpus ------------------------------------------------------------------------------


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), "zstd", asbytes=True) if len(x) else b""


def _whole(data: bytes | None, n: int, dtype: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(dtype).itemsize, "zstd", asbytes=True) if n else b"", dtype)


#: Rows of a block: one for each distinct word, with its number in the block and its count in training documents, and one with `data`, all that scoring needs, and `learnt`, all that training does.
TOLD = "block long, number int, word binary, n long, data binary, learnt binary"
_TOLD_ARROW = pa.schema([("block", pa.int64()), ("number", pa.int32()), ("word", pa.binary()), ("n", pa.int64()), ("data", pa.binary()), ("learnt", pa.binary())])


def _told(batches: Iterator[pa.RecordBatch], tokenizer: str, pattern: str) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows: (doc_id, training, text)."""
    subwords, block = Subwords(tokenizer, pattern), TaskContext.get().partitionId() << 32

    def rows(**columns) -> pa.RecordBatch:
        n = len(columns["block"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _TOLD_ARROW], schema=_TOLD_ARROW)

    for part in _cut(batches):
        words, lengths = word_lists(part.column("text"))
        coded = words.dictionary_encode()
        numbers, own = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        part = part.drop_columns(["text"])
        del words, coded
        training = part.column("training").to_numpy(zero_copy_only=False).astype(bool)
        often = np.argsort(-np.bincount(numbers, minlength=len(own)), kind="stable")  # frequent words get low numbers
        rank = np.empty(len(own), np.int32)
        rank[often] = np.arange(len(own))
        numbers, own = rank[numbers], own.take(pa.array(often))
        learnt = numbers[np.repeat(training, lengths)]
        n = np.bincount(learnt, minlength=len(own))
        ids, bounds = subwords.of(own.to_pylist())
        ids = ids.astype("<u2")
        stream = training_stream(ids, bounds, learnt, lengths[training], subwords.size)
        del learnt
        keys, n_pairs = pairs_of(stream)
        counts = sum((np.bincount(stream[i : i + (1 << 18)], minlength=subwords.size + 1) for i in range(0, len(stream), 1 << 18)), np.int64(0))[: subwords.size]
        used = np.flatnonzero(counts)
        ids_of = part.column("doc_id")
        yield rows(block=np.full(len(own), block), number=np.arange(len(own)), word=own.cast(pa.binary()), n=n)
        data = {
            "doc_ids": _squeezed(pc.fill_null(ids_of, 0).to_numpy(zero_copy_only=False)), "no_id": _squeezed(pc.is_null(ids_of).to_numpy(zero_copy_only=False)),
            "training": _squeezed(training), "lengths": _squeezed(lengths), "numbers": _squeezed(numbers.astype("<i4")), "bounds": _squeezed(bounds.astype("<i4")), "ids": _squeezed(ids),
            "n_docs": len(lengths), "n_words": len(own), "n_tokens": len(numbers), "n_ids": len(ids),
        }
        learnt = {
            "pairs": _squeezed(keys), "pair_counts": _squeezed(n_pairs.astype("<i8")),
            "subwords": _squeezed(used.astype("<i4")), "subword_counts": _squeezed(counts[used].astype("<i8")), "n_pairs": len(keys), "n_subwords": len(used),
        }
        yield rows(block=[block], data=[pickle.dumps(data)], learnt=[pickle.dumps(learnt)])
        del numbers, own, ids, bounds, stream, keys, n_pairs, part, ids_of, data, learnt
        give_back()
        block += 1


def training_stream(ids: np.ndarray, bounds: np.ndarray, learnt: np.ndarray, lengths: np.ndarray, end: int) -> np.ndarray:
    """The ids of a block's training texts in one stream, each led and the last followed by an end.

    learnt: word numbers of all training texts in a row; lengths: words of each.
    """
    before = np.concatenate([[0], np.cumsum(np.diff(bounds)[learnt])])
    spread = np.diff(before[np.concatenate([[0], np.cumsum(lengths)])]) + 1
    stream = np.full(spread.sum() + 1, end, "<u2")
    inner = np.ones(len(stream), bool)
    inner[np.cumsum(spread) - spread], inner[-1] = False, False
    stream[inner] = gathered(ids, bounds, learnt)
    return stream


def stream_of(block: dict, end: int) -> np.ndarray:
    """The training stream of a written block."""
    training, lengths = _whole(block["training"], block["n_docs"], "?"), _whole(block["lengths"], block["n_docs"], "<i8")
    numbers, bounds = _whole(block["numbers"], block["n_tokens"], "<i4"), _whole(block["bounds"], block["n_words"] + 1, "<i4").astype(np.int64)
    return training_stream(_whole(block["ids"], block["n_ids"], "<u2"), bounds, numbers[np.repeat(training, lengths)], lengths[training], end)


def whole_windows(stream: np.ndarray) -> np.ndarray:
    """(windows, CONTEXT + 1) ids that a stream is cut into: each id but the first is foretold once. The last window goes on with ends."""
    n = -(-(len(stream) - 1) // CONTEXT)
    if not n:
        return np.empty((0, CONTEXT + 1), stream.dtype)
    padded = np.concatenate([stream, np.full(n * CONTEXT + 1 - len(stream), stream[-1])])
    return np.lib.stride_tricks.sliding_window_view(padded, CONTEXT + 1)[::CONTEXT]


def pairs_of(stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first id * 2^16 + second id, how often) of neighbouring ids, in the order of the keys; sorted in place."""
    keys = stream[:-1].astype("<u4")
    keys <<= np.uint32(16)
    keys |= stream[1:]
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[first], np.diff(first, append=len(keys)).astype(np.int64)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in parts of about BLOCK_BYTES of text."""
    held, room = [], BLOCK_BYTES
    for batch in batches:
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0
        while at < len(size):
            end = at + int(np.searchsorted(np.cumsum(size[at:]), room, "right"))
            if end == at and not held:
                end += 1  # one text with more than a block
            if end > at:
                held.append(batch.slice(at, end - at))
                room -= int(size[at:end].sum())
            at = end
            if at < len(size):
                yield pa.concat_batches(held)
                held, room = [], BLOCK_BYTES
    if held:
        yield pa.concat_batches(held)


def training_windows(stream: np.ndarray, heads: np.ndarray, sizes: np.ndarray, each: int, rng: np.random.Generator) -> np.ndarray:
    """(windows, CONTEXT + 1) ids of a block's training stream: from every text a window for each WINDOW_IDS ids, and one more.

    The model is no longer fitted on these but on whole_windows().

    If `each` is greater, that many, but no more than cover the text. They start at random in equal parts of the text.
    """
    n = np.maximum(1 + sizes // WINDOW_IDS, np.minimum(sizes // CONTEXT, each))
    of = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    start = heads[of] + ((k + rng.random(len(of))) * sizes[of] / n[of]).astype(np.int64)
    stream = np.concatenate([stream, np.full(CONTEXT, stream[-1])])  # a block's last window goes on with ends
    return stream[start[:, None] + np.arange(CONTEXT + 1)]


def subword_counts(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each subword occurs in training documents: one figure for each id of the tokenizer."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(size, np.int64)
        for batch in batches:
            for b in map(pickle.loads, batch["learnt"]):
                out[_whole(b["subwords"], b["n_subwords"], "<i4")] += _whole(b["subword_counts"], b["n_subwords"], "<i8")
        used = np.flatnonzero(out)
        yield pd.DataFrame({"id": used, "n": out[used]})

    out = np.zeros(size, np.int64)
    for r in blocks.select("learnt").mapInPandas(told, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r.id] = r.n
    return out


def vocabulary(counts: np.ndarray, leads: np.ndarray, n_docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, rare_log, unigram): the model id of each subword, rare ones' log shares of their kind, chances of model ids.

    leads: whether a subword starts a word. The most frequent of either kind have ids of their own.
    """
    known = np.where(leads, RARE_START, RARE_ON)
    unigram, rare_log = np.zeros(IDS), np.zeros(len(counts))
    unigram[END] = n_docs + 1
    for kind, first, room in ((leads, RARE_START, STARTS * MEMBERS - 2), (~leads, RARE_ON, (CLASSES - STARTS) * MEMBERS - 1)):
        own = np.flatnonzero(kind)
        top = own[np.argsort(-counts[own], kind="stable")[:room]]
        top = top[counts[top] > 0]
        known[top] = first + 1 + np.arange(len(top))
        unigram[first + 1 : first + 1 + len(top)] = counts[top]
        rest = np.setdiff1d(own, top)
        unigram[first] = counts[rest].sum() + 1
        rare_log[rest] = np.log((counts[rest] + 1) / (counts[rest] + 1).sum())
    return known, rare_log, unigram / unigram.sum()


def pair_table(blocks: DataFrame, model_id: np.ndarray) -> np.ndarray:
    """How often each model id followed each in training; model_id: of every subword, last of the end. IDS * IDS figures."""

    def told(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = np.zeros(IDS * IDS)
        for batch in batches:
            for b in map(pickle.loads, batch["learnt"]):
                keys = _whole(b["pairs"], b["n_pairs"], "<u4").astype(np.int64)
                out += np.bincount(model_id[keys >> 16] * IDS + model_id[keys & 0xFFFF], weights=_whole(b["pair_counts"], b["n_pairs"], "<i8"), minlength=IDS * IDS)
        at = np.flatnonzero(out)
        yield pd.DataFrame({"key": at, "n": out[at].astype(np.int64)})
        give_back()

    def row(key, part: pd.DataFrame) -> pd.DataFrame:  # IDS rows at most
        out = np.zeros(IDS)
        out[part["key"].to_numpy() % IDS] = part["n"]
        return pd.DataFrame({"a": [key[0]], "n": [out.tobytes()]})

    sums = blocks.select("learnt").mapInPandas(told, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    found = sums.withColumn("a", F.expr(f"key div {IDS}")).groupBy("a").applyInPandas(row, "a long, n binary").collect()
    out = np.zeros((IDS, IDS))
    for r in found:
        out[r.a] = np.frombuffer(r.n)
    return out


def _averaged(rows: DataFrame, parts: int) -> np.ndarray | None:
    """The mean of (part, n, model) rows' models by n, level by level, FAN at a time."""

    def mean(key, some: pd.DataFrame) -> pd.DataFrame:
        weight = some["n"].to_numpy(np.float64)
        total = sum(w * np.frombuffer(x, "<f4").astype(np.float64) for w, x in zip(weight, some["model"], strict=True))
        return pd.DataFrame({"part": [key[0]], "n": [int(weight.sum())], "model": [(total / weight.sum()).astype("<f4").tobytes()]})

    while parts > FAN:
        parts = -(-parts // FAN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(parts))).groupBy("part").applyInPandas(mean, "part int, n long, model binary")
    found = rows.collect()  # FAN models at most
    return sum(r.n * np.frombuffer(r.model, "<f4").astype(np.float64) for r in found) / sum(r.n for r in found) if found else None


def fit(blocks: DataFrame, n: int, model_id: np.ndarray, unigram: np.ndarray) -> dict[str, np.ndarray]:
    """The model after all rounds; blocks: (data) with the training documents, which have about n windows.

    A task goes over its blocks one after the other, each made again from what scoring has of it, so no windows are kept.
    """
    m, end = started_model(unigram), len(model_id) - 1
    epochs = max(1, min(EPOCHS, round(EPOCHS * LEAST_WINDOWS / max(n, 1))))
    rounds = max(ROUNDS, epochs)
    data = blocks.select("data")
    parts = data.rdd.getNumPartitions() if n else 0
    for r in range(rounds if n else 0):

        def go_on(batches: Iterator[pd.DataFrame], r=r, m=m) -> Iterator[pd.DataFrame]:
            seen = 0
            with holding_memory():
                for batch in batches:
                    for told in batch["data"]:
                        some = whole_windows(stream_of(pickle.loads(told), end))
                        some = model_id[some[(np.arange(len(some)) + r) % rounds < epochs]]  # each window `epochs` times in all rounds
                        if len(some):
                            m, seen = trained(m, some, r / rounds, (r + 1) / rounds, SEED + r), seen + len(some)
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [seen], "model": [packed(m).astype("<f4").tobytes()]})

        found = _averaged(data.mapInPandas(go_on, "part int, n long, model binary"), parts)
        m = m if found is None else unpacked(found)
    return m


def learn(blocks: DataFrame, words: DataFrame, n_docs: int, tokenizer: str, pattern: str) -> dict:
    """All that scoring needs but word counts. blocks: (block, data, learnt); words: (word, c) of the training documents."""
    subwords = Subwords(tokenizer, pattern)
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    counts = subword_counts(blocks, subwords.size)
    known, rare_log, unigram = vocabulary(counts, subwords.leads, n_docs)
    model_id = np.append(known, END)
    pairs = pair_table(blocks, model_id)
    total = np.maximum(pairs.sum(axis=1, keepdims=True), 1)
    starts = np.arange(IDS) < STARTS * MEMBERS
    model = fit(blocks, -(-(int(counts.sum()) + n_docs) // CONTEXT), model_id, unigram)
    return {
        "model": model, "tables": tables(model), "known": known, "rare_log": rare_log, "n_docs": n_docs, "n_all": (sums.n or 0) + n_docs, "n_distinct": (sums.v or 0) + (n_docs > 0),
        "pairs": (pairs / total).astype(np.float32), "begins": (pairs[:, starts].sum(axis=1) / total[:, 0]).astype(np.float32),
    }


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score_block(learnt: dict, block: dict, number: np.ndarray, count: np.ndarray) -> dict[str, pa.Array]:
    """A block's results; number, count: its distinct words' counts in training documents."""
    n, n_all = block["n_docs"], learnt["n_all"]
    c = np.zeros(block["n_words"], np.int64)
    c[number] = count
    lengths, numbers = _whole(block["lengths"], n, "<i8"), _whole(block["numbers"], block["n_tokens"], "<i4")
    ids, bounds = _whole(block["ids"], block["n_ids"], "<u2"), _whole(block["bounds"], block["n_words"] + 1, "<i4").astype(np.int64)
    ends = np.cumsum(lengths + 1) - 1  # each text's end follows its words
    of_words = np.full(len(numbers) + n, learnt["n_docs"], np.int64)
    inner = np.ones(len(of_words), bool)
    inner[ends] = False
    of_words[inner] = c[numbers]
    # The contract's base as (c + 1) / (N + V + 1); see the README for how its formula is read.
    floor = float(np.log10(n_all + learnt["n_distinct"] + 1))
    base = np.add.reduceat(np.log10(of_words + 1) - floor, ends - lengths)
    size = np.diff(bounds)
    words_before = np.concatenate([[0], np.cumsum(lengths)])
    # Texts of the same words have the same score: each is worked out once in a block.
    first: dict[bytes, int] = {}
    same = np.array([first.setdefault(numbers[a:b].tobytes(), i) for i, (a, b) in enumerate(zip(words_before[:-1], words_before[1:], strict=True))], np.int64)
    own = np.flatnonzero(same == np.arange(n))
    sizes = np.diff(np.concatenate([[0], np.cumsum(size[numbers])])[words_before])[own]
    found, at = np.empty(n), 0
    while at < len(own):  # as many texts at once as make SCORE_IDS ids
        end = max(at + 1, at + int(np.searchsorted(np.cumsum(sizes[at:]), SCORE_IDS, "right")))
        texts = own[at:end]
        some = np.concatenate([numbers[words_before[i] : words_before[i + 1]] for i in texts])
        firsts = np.zeros(int(sizes[at:end].sum()), bool)
        firsts[np.cumsum(size[some]) - size[some]] = True
        shares = np.concatenate([of_words[words_before[i] + i : words_before[i + 1] + i + 1] for i in texts]) / max(1, n_all)
        found[texts] = scores(learnt, gathered(ids, bounds, some), sizes[at:end], firsts, shares, lengths[texts])
        at = end
    found = found[same]
    return {
        "doc_id": pa.array(_whole(block["doc_ids"], n, "<i8"), pa.int64(), mask=_whole(block["no_id"], n, "?")), "held_out": pa.array(~_whole(block["training"], n, "?")),
        "n_tokens": pa.array(lengths + 1), "n_known": pa.array(np.add.reduceat((of_words > 0).astype(np.int64), ends - lengths)),
        "train_tokens": pa.array(np.full(n, n_all, np.int64)), "base_score": pa.array(base), "score": pa.array(found),
    }


_SCORED_ARROW = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]


def prepared(docs: DataFrame, tokenizer: str, pattern: str) -> tuple[DataFrame, DataFrame, dict]:
    """(the written blocks, (block, number, c) of their words, what is learnt from the training documents)."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.pmod(crc_of_id(), F.lit(FOLDS)) != HELD_OUT, F.lit(True)).alias("training"),
        "text",
    )
    n_docs = rows.filter("training").count()
    with small_batches(docs.sparkSession, 1000):
        told = staged(rows.mapInArrow(lambda it: _told(it, tokenizer, pattern), TOLD), "lm-blocks")
    blocks = told.filter("data is not null").select("block", "data", "learnt")
    same = Window.partitionBy("word")
    counted = told.filter("data is null").select("block", "number", F.sum("n").over(same).alias("c"), (F.min("block").over(same) == F.col("block")).alias("one"))
    counted = staged(counted, "lm-counts")  # a word has one row for each block it is in
    return blocks, counted, learn(blocks, counted.filter("one").select("c"), n_docs, tokenizer, pattern)


def scored(docs: DataFrame, tokenizer: str, pattern: str) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    blocks, counted, learnt = prepared(docs, tokenizer, pattern)

    def score(block: pa.Table, words: pa.Table) -> pa.Table:
        with holding_memory():
            out = [_score_block(learnt, pickle.loads(b), words.column("number").to_numpy(), words.column("c").to_numpy()) for b in block.column("data").to_pylist()]
        return pa.concat_tables([pa.table(x) for x in out]) if out else pa.schema(_SCORED_ARROW).empty_table()

    # Four times as many parts as blocks, so that few blocks share one.
    parts = max(1, min(4 * blocks.count(), 100_000))
    words = counted.select("block", "number", "c").repartition(parts, "block")
    narrow = blocks.select("block", "data").repartition(parts, "block")
    return narrow.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(score, SCORED)
