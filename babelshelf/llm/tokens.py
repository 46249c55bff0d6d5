"""Token ids and counts of whole texts by a ``tokenizers`` file, through caches of text pieces.

A byte-level BPE splitter always cuts before a single space that stands between two other characters, and around
a single newline that does. Pieces between such points are encoded alone, once for each worker as long as they
stay in its cache, and put together again with numpy. Texts with other runs of blanks are first re-joined
around these, so that a piece never begins or ends at a doubtful point.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

TOKENIZER = "byte_bpe_50k.json"
#: Text handled at once by a worker, unless a single text is longer.
BLOCK_BYTES = 12 << 20
#: Pieces in each of the two generations of a worker's cache.
CACHE_PIECES = 400_000
_encoders: dict[tuple, "PieceEncoder"] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public vocabulary file lies; a path is returned as it is."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def load(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


class Generations:
    """A dictionary of bounded size: when the young half is full it becomes the old one, which is forgotten."""

    def __init__(self, most: int = CACHE_PIECES):
        self.most, self.young, self.old = most, {}, {}

    def find(self, keys: list) -> list:
        """Values in order, None where unknown."""
        found = list(map(self.young.get, keys))
        if self.old:
            again = [i for i, x in enumerate(found) if x is None and keys[i] in self.old]
            names = [keys[i] for i in again]
            values = list(map(self.old.get, names))
            for i, x in zip(again, values, strict=True):
                found[i] = x
            self.put_all(names, values)
        return found

    def put(self, key, value) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = value

    def put_all(self, keys: list, values: list) -> None:
        for at in range(0, len(keys), self.most):
            part = keys[at : at + self.most]
            if len(self.young) + len(part) > self.most:
                self.old, self.young = self.young, {}
            self.young.update(zip(part, values[at : at + self.most], strict=True))


def marked(texts: pa.Array) -> pa.Array:
    """Texts led by a newline, with a space before every other newline: split at spaces, each piece is ``\\nword`` or ``word``."""
    newline, nothing = pa.scalar("\n", pa.large_string()), pa.scalar("", pa.large_string())
    return pc.binary_join_element_wise(newline, pc.replace_substring(texts, "\n", " \n"), nothing)


def is_safe(piece: str) -> bool:
    """True if the splitter surely cuts before and after the piece, ``word`` standing for `` word``."""
    body = piece[1:] if piece[:1] == "\n" else piece
    return bool(body) and not body[0].isspace() and not body[-1].isspace()


_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
_SAFE = rf"(?s)^\n?[^{_SPACES}](?:.*[^{_SPACES}])?$"


def safe(pieces: pa.Array) -> np.ndarray:
    """``is_safe`` of each piece."""
    return pc.match_substring_regex(pieces, _SAFE).to_numpy(zero_copy_only=False)


def as_text(piece: str) -> str:
    return piece if piece[0] == "\n" else " " + piece


def rejoined(pieces: list[str]) -> list[str]:
    """A text, from all its pieces, parted only where the splitter surely cuts."""
    out = [pieces[0][1:]]
    ends_well = out[0] != "" and not out[0][-1].isspace()
    for piece in pieces[1:]:
        body = piece.removeprefix("\n")
        if ends_well and body and not body[0].isspace():
            out.append(as_text(piece))
        else:
            out[-1] += as_text(piece) if piece else " "
        ends_well = body != "" and not body[-1].isspace()
    return out


class PieceEncoder:
    """Encodes Arrow arrays of texts; one for each worker and vocabulary file."""

    def __init__(self, path: str, cache: int = CACHE_PIECES):
        self.tokenizer, self.cache = load(path), Generations(cache)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.n_ids = max(vocab.values()) + 1
        self.dtype = np.dtype("<u2" if self.n_ids <= 1 << 16 else "<u4")
        self.begins = np.zeros(self.n_ids, dtype=bool)
        for token, i in vocab.items():
            self.begins[i] = token[0] == "Ġ" or token == "Ċ"
        probe = "\n" + "ab"
        ids = self.encode([probe, " a b\nc", "\n\n"])
        #: Whether pieces work as assumed; if not, every text is encoded as a whole.
        self.by_piece = len(ids[0]) > 1 and vocab.get("Ċ") == ids[0][0] and list(self.begins[ids[1]]) == [True, True, True, False]

    def words(self) -> list[str]:
        """Texts of the ids that begin with a space or are a newline and more, by id."""
        ids = np.flatnonzero(self.begins).tolist()
        texts = [self.tokenizer.decode([i]) for i in ids]
        return [x for x in texts if len(x) > 1 and x[0] in " \n" and "\ufffd" not in x]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of safe pieces as bytes. They are encoded as one text and parted before each space or newline."""
        out: list[bytes] = []
        for at in range(0, len(pieces), 4096):
            some = pieces[at : at + 4096]
            ids = np.array(self.encode(["".join(map(as_text, some))])[0], dtype=self.dtype)
            starts = np.flatnonzero(self.begins[ids])
            if len(starts) == len(some) and starts[0] == 0:
                raw, ends = ids.tobytes(), [*(starts[1:] * self.dtype.itemsize).tolist(), ids.nbytes]
                out += [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                out += [np.array(x, dtype=self.dtype).tobytes() for x in self.encode(list(map(as_text, some)))]
        return out

    def encode_doubtful(self, pieces: list[str]) -> np.ndarray:
        """Ids of a text with pieces that aren't safe."""
        return np.array([i for ids in self.encode(rejoined(pieces)) for i in ids], dtype=self.dtype)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): ids of all texts in a row, and where each text's end."""
        if not self.by_piece:
            found = [np.array(x, dtype=self.dtype) for x in self.encode(texts.to_pylist())]
            return np.cumsum([len(x) for x in found], dtype=np.int64), np.concatenate([*found, np.zeros(0, self.dtype)])
        offsets, index, coded = split(texts)
        words = coded.to_pylist()
        found = self.cache.find(words)
        known = np.fromiter((x is not None for x in found), dtype=bool, count=len(found))
        missing = np.flatnonzero(~known & safe(coded)).tolist()
        names = [words[i] for i in missing]
        new = self.encode_pieces(names)
        for i, ids in zip(missing, new, strict=True):
            found[i] = ids
        self.cache.put_all(names, new)
        bad = np.array([x is None for x in found], dtype=bool)
        raw = [x or b"" for x in found]
        flat = np.frombuffer(b"".join(raw), dtype=self.dtype)
        lens = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // self.dtype.itemsize
        starts = np.cumsum(lens) - lens
        n_piece = lens[index]
        piece_ends = np.cumsum(n_piece)
        total = int(piece_ends[-1]) if len(piece_ends) else 0
        ids = flat[np.repeat(starts[index] - (piece_ends - n_piece), n_piece) + np.arange(total)]
        row_ends = np.concatenate([[0], piece_ends])[offsets[1:]]
        # The first id of each text is that of the leading newline.
        row_starts = np.concatenate([[0], row_ends[:-1]])[: len(row_ends)]
        doubtful = np.add.reduceat(bad[index], offsets[:-1]) > 0 if len(index) else np.zeros(0, bool)
        if not doubtful.any():
            keep = np.ones(total, dtype=bool)
            keep[row_starts] = False
            return row_ends - np.arange(1, len(row_ends) + 1), ids[keep]
        parts, sizes = [], []
        for r, odd in enumerate(doubtful.tolist()):
            if odd:
                part = self.encode_doubtful([words[i] for i in index[offsets[r] : offsets[r + 1]]])
            else:
                part = ids[row_starts[r] + 1 : row_ends[r]]
            parts.append(part)
            sizes.append(len(part))
        return np.cumsum(sizes, dtype=np.int64), np.concatenate(parts)


def split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, index, words): text r has the pieces words[index[offsets[r]:offsets[r + 1]]], one at least."""
    lists = pc.split_pattern(marked(texts), " ")
    coded = pc.dictionary_encode(lists.flatten())
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return offsets - (offsets[0] if len(offsets) else 0), coded.indices.to_numpy(), coded.dictionary


def encoder(path: str, cache: int = CACHE_PIECES) -> PieceEncoder:
    """This worker's encoder with a cache of this size."""
    if (path, cache) not in _encoders:
        _encoders[path, cache] = PieceEncoder(path, cache)
    return _encoders[path, cache]


def blocks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batches with about ``most`` bytes of text, and their texts without nulls."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = pc.fill_null(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string()), "")
        group = np.cumsum(pc.binary_length(texts).to_numpy()) // most
        edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            yield batch.slice(a, b - a), texts.slice(a, b - a)
