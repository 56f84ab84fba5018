"""Token ids of whole texts, by a public tokenizer file: an Arrow batch at a time, each distinct word once."""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from scriptorium.llm.common import worker_cache

#: The tokenizer file that the queries name; any path can be given instead.
DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: A word that is one run of Latin letters and perhaps one run of closing marks: two pre-tokens at most.
_PLAIN = "^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]*)(?P<tail>[.,;:!?#$%&*+=/\\\\()|-]*)$"
#: Words whose ids are copied at a time; bounds what a very long text takes besides its ids.
_STEP = 1 << 18
#: Parts encoded by one call.
_CALL = 4000


def ragged(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The concatenation of ``pool[b : b + n]`` for each begin ``b`` and size ``n``."""
    stop = np.cumsum(size)
    total = int(stop[-1]) if len(stop) else 0
    return pool[np.repeat(begin - (stop - size), size) + np.arange(total)]


class WordEncoder:
    """Encodes texts by their distinct words.

    Right for tokenizers whose pre-tokenizer never joins text across ASCII
    white space and drops that space (as ``word_bpe_49k.json`` does); the tests
    hold it against whole-text encoding.  ``budget`` bounds the bytes of the
    remembered words.

    Where the vocabulary marks the end of a word, plain words are looked up by
    their letters and their marks, which are pre-tokens of their own: one call
    encodes many, and the marked ids tell where each ends.
    """

    def __init__(self, path: str, budget: int | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache = worker_cache(f"tokens {path}", budget)
        self._forget()
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = None
        if suffix:
            vocab = self.tokenizer.get_vocab(with_added_tokens=False)
            self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)
            self.closing[[i for piece, i in vocab.items() if piece.endswith(suffix)]] = True

    def _forget(self) -> None:
        self.cache.clear()
        self.ids, self.begin = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def _keep(self, keys: list[str]) -> None:
        """Make room: forget all words but ``keys``."""
        slots = np.fromiter(map(self.cache.known.__getitem__, keys), dtype=np.int64, count=len(keys))
        size = np.diff(self.begin)[slots]
        ids = ragged(self.ids, self.begin[slots], size)
        self._forget()
        self.cache.remember(dict(zip(keys, range(len(keys)), strict=True)))
        self.ids, self.begin = ids, np.concatenate([[0], np.cumsum(size)])

    def _together(self, parts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of plain parts, and how many each has."""
        ids, sizes = [], []
        for lo in range(0, len(parts), _CALL):
            some = parts[lo : lo + _CALL]
            found = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closing[found]) + 1
            if len(ends) != len(some):
                raise ValueError("this vocabulary's end marks don't match its pre-tokens")
            ids.append(found)
            sizes.append(np.diff(ends, prepend=0))
        return ids, sizes

    def _singly(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        ids, sizes = [], []
        for lo in range(0, len(words), _CALL):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(words[lo : lo + _CALL], add_special_tokens=False)]
            ids.append(np.array([i for x in found for i in x], dtype=np.uint32))
            sizes.append(np.array([len(x) for x in found], dtype=np.int64))
        return ids, sizes

    def _slots(self, groups: list[tuple[list[str], bool]]) -> list[np.ndarray]:
        """The slot in ``ids`` of every key of each group; the flag says whether keys are plain parts."""
        if len(self.begin) != len(self.cache.known) + 1:  # emptied for another operator, or the last batch was too large to keep
            self._forget()
        missing = [[k for k in keys if k not in self.cache.known] for keys, _ in groups]
        if self.cache.bytes + sum(map(self.cache.cost, missing)) > self.cache.budget:
            self._keep([k for keys, _ in groups for k in keys if k in self.cache.known])
        ids, sizes = [self.ids], [np.diff(self.begin)]
        slot = len(self.begin) - 1
        new: dict[str, int] = {}
        for keys, (_, plain) in zip(missing, groups, strict=True):
            i, n = (self._together if plain else self._singly)(keys)
            ids += i
            sizes += n
            new.update(zip(keys, range(slot, slot + len(keys)), strict=True))
            slot += len(keys)
        if new:
            self.ids, self.begin = np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        known = self.cache.remember(new)
        return [np.fromiter(map(known.__getitem__, keys), dtype=np.int64, count=len(keys)) for keys, _ in groups]

    def encode_texts(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): all ids in a row, and where each text's ids (then ``end_id``, if given) end; null is empty."""
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = lists.flatten().dictionary_encode()
        per_text = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        distinct, which = words.dictionary, words.indices.to_numpy(zero_copy_only=False)
        del lists, words
        begin, size, pool = self._distinct(distinct)
        if end_id is not None:
            which = np.insert(which, np.cumsum(per_text), len(begin))  # 32 bits: there are fewer words than bytes in a batch
            begin, size, pool, per_text = np.append(begin, len(pool)), np.append(size, 1), np.append(pool, np.uint32(end_id)), per_text + 1
        out = [ragged(pool, begin[which[lo : lo + _STEP]], size[which[lo : lo + _STEP]]) for lo in range(0, len(which), _STEP)]
        ends = np.concatenate([[0], np.cumsum(size[which])])[np.cumsum(per_text)] if len(per_text) else np.zeros(0, np.int64)
        return (np.concatenate(out) if out else np.zeros(0, np.uint32)), ends

    def _distinct(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, size, pool) of the ids of each distinct word."""
        parted = pc.extract_regex(words, pattern=_PLAIN) if self.closing is not None else None
        plain = pc.is_valid(parted) if parted is not None else pa.array(np.zeros(len(words), dtype=bool))
        odd = words.filter(pc.invert(plain))
        groups: list[tuple[list[str], bool]] = [(odd.to_pylist(), False)]
        coded = []
        if parted is not None:
            parted = parted.filter(plain)
            for i in (0, 1):
                part = pc.utf8_lower(pc.struct_field(parted, [i])).dictionary_encode()
                coded.append(part.indices.to_numpy(zero_copy_only=False))
                names = part.dictionary.to_pylist()
                empty = names.index("") if "" in names else -1
                groups.append(([x for x in names if x], True))
                # Indexes into the group without the empty part; -1 stands for that.
                shift = np.arange(len(names)) - (np.arange(len(names)) > empty if empty >= 0 else 0)
                if empty >= 0:
                    shift[empty] = -1
                coded[-1] = shift[coded[-1]]
        slots = self._slots(groups)
        begin, size = np.append(self.begin[:-1], 0), np.append(np.diff(self.begin), 0)  # -1: nothing
        first, second = np.full(len(words), -1, np.int64), np.full(len(words), -1, np.int64)
        is_plain = plain.to_numpy(zero_copy_only=False)
        first[~is_plain] = slots[0]
        if coded:
            first[is_plain], second[is_plain] = (np.append(s, -1)[c] for s, c in zip(slots[1:], coded, strict=True))
        both = np.stack([first, second], axis=1).ravel()
        pool = ragged(self.ids, begin[both], size[both])
        n = size[first] + size[second]
        return np.cumsum(n) - n, n, pool


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """This worker's encoder for a tokenizer file (kept between tasks)."""
    if path not in _ENCODERS:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _ENCODERS[path] = WordEncoder(path)
    worker_cache(_ENCODERS[path].cache.name)  # empties those of other operators
    return _ENCODERS[path]


def tokenizer_path(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
