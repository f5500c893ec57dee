"""Token ids by a tokenizer's file, with a faster library for texts that both split alike."""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np

#: Texts of these characters are split alike by every regex library; others go to the tokenizer itself.
_PLAIN = re.compile(r"[ \t\n\r!-~À-ÖØ-öø-ſ]*")
_SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_ranks(model: dict) -> dict[bytes, int] | None:
    """Ranks of a byte-level BPE by its bytes; None if its ids aren't in the order of its merges."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}
    vocab, merges = model["vocab"], model["merges"]
    merged = ["".join(m.split(" ") if isinstance(m, str) else m) for m in merges]
    if any(vocab[m] != 256 + i for i, m in enumerate(merged)) or any(vocab[c] > 255 for c in byte):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items() if i < 256 + len(merges)}


def _split_is_known(config: dict) -> bool:
    """Whether the file splits texts by ``_SPLIT`` and by nothing else, so that both libraries merge the same pieces."""
    split, model = config.get("pre_tokenizer") or {}, config["model"]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and config.get("normalizer") is None
    return plain and model.get("type") == "BPE" and not any(model.get(x) for x in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))


class Encoder:
    """Ids of texts as little-endian 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        ranks = _byte_ranks(config["model"]) if _split_is_known(config) else None
        self.fast = tiktoken.Encoding("fast", pat_str=_SPLIT, mergeable_ranks=ranks, special_tokens={}) if ranks else None

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return self.whole(text)
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


@functools.cache
def encoder(path: str) -> Encoder:
    """Read once in a worker."""
    return Encoder(path)
