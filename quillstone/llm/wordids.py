"""Word-wise tokenisation of whole batches.

The vocabulary's normaliser and pre-tokeniser never join characters across ASCII white space, so
a text's ids are those of its white-space separated words in turn, and a word of Latin letters
between punctuation marks is three runs with ids of their own.  A batch's words are made distinct
by Arrow's dictionary encoding; only the distinct ones are tokenised, and the batch's ids are
gathered from them with numpy.  The ids of runs are remembered, in two generations of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Texts that hold the spelling of a special token are encoded whole.
SPECIAL = "<|"

#: Marks, Latin-1 letters (all stable under NFC), marks.  An apostrophe before letters may begin a
#: contraction, hence the first run has none.
PARTS = r"^(?P<a>[!-&(-/:-@\[-`{-~]*)(?P<b>[a-zÀ-ÖØ-öø-ÿ]+)(?P<c>[!-/:-@\[-`{-~]*)$"


class WordIds:
    def __init__(self, path: str, most: int = 200_000):
        self.tokenizer = Tokenizer.from_file(path)
        ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")}
        self.ends = np.array([i in ends for i in range(self.tokenizer.get_vocab_size())])
        self.runs: dict[str, bytes] = {"": b""}
        self.old_runs: dict[str, bytes] = {}
        self.most = most  # of a generation, of some 120 bytes each

    def _encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, runs: list[str], whole: set[int]) -> list[bytes]:
        """The ids of distinct runs.  New ones go many to a call, since every run ends with the only
        id that ends a word; but for those at the places ``whole``, which are words of any kind."""
        known = list(map(self.runs.get, runs))
        fresh = [i for i, ids in enumerate(known) if ids is None]
        older = self.old_runs
        new = []
        for i in fresh:
            known[i] = older.get(runs[i])
            if known[i] is None:
                if i in whole:
                    known[i] = self._encode(runs[i]) if runs[i] else b""
                else:
                    new.append(i)
        for a in range(0, len(new), 1000):
            part = new[a : a + 1000]
            ids = np.array(self.tokenizer.encode(" ".join([runs[i] for i in part]), add_special_tokens=False).ids, "<u4")
            ends = (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) == len(part):
                raw = ids.tobytes()
                for i, x, y in zip(part, [0, *ends], ends):
                    known[i] = raw[x:y]
            else:
                for i in part:
                    known[i] = self._encode(runs[i])
        if len(self.runs) > self.most:
            self.runs, self.old_runs = {}, self.runs
            fresh = range(len(runs))
        self.runs.update((runs[i], known[i]) for i in fresh)  # what is used stays young
        return known

    def _parts(self, words: pa.Array) -> tuple[list[str], np.ndarray, set[int]]:
        """Distinct runs of distinct words, every word's three, and which runs are whole words."""
        found = pc.extract_regex(words, PARTS)
        odd = found.is_null()
        columns = [pc.if_else(odd, "", pc.coalesce(found.field(0), "")), pc.if_else(odd, words, found.field(1)), pc.if_else(odd, "", pc.coalesce(found.field(2), ""))]
        runs = pa.concat_arrays(columns).dictionary_encode()
        three = runs.indices.to_numpy().reshape(3, -1).T
        return runs.dictionary.to_pylist(), three, set(three[odd.to_numpy(zero_copy_only=False), 1].tolist())

    def encode_all(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids (little-endian uint32) of every text of a string array without nulls, in order."""
        special = pc.match_substring(texts, SPECIAL)
        plain = pc.if_else(special, "", texts) if special.true_count else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = split.flatten().dictionary_encode()
        runs, three, whole = self._parts(words.dictionary)
        known = self._known(runs, whole)
        size = np.fromiter(map(len, known), np.int32, len(known)) // 4
        pool = np.frombuffer(b"".join(known), "<u4")
        first = np.cumsum(size) - size
        # the ids of the distinct words, then those of all words
        n = size[three.ravel()]
        upto = np.cumsum(n) - n
        pool = pool[np.repeat(first[three.ravel()] - upto, n) + np.arange(n.sum())]
        size = n.reshape(-1, 3).sum(1)
        first = np.cumsum(size) - size
        code = words.indices.to_numpy()
        n = size[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[code] - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[np.concatenate([[0], np.cumsum(split.value_lengths().to_numpy())])].tolist()
        for i, (a, b) in enumerate(zip(bounds, bounds[1:])):
            yield np.frombuffer(self._encode(texts[i].as_py()), "<u4") if special[i].as_py() else ids[a:b]
