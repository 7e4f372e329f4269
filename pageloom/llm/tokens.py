"""Identifiers of texts under a public byte-level vocabulary, as packed little-endian numbers."""

from __future__ import annotations

import json
import re

import numpy as np

# Characters that every version of Unicode classes alike: letters, numbers, blanks, and other signs. Texts with any beyond
# them are left to the tokenizer itself.
LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏΑ-ΡΣ-ώЀ-ҁぁ-んァ-ヴ一-龥"
NUMBERS = "0-9²³¹¼-¾"
BLANKS = "\t-\r\x20\xa0"
SIGNS = "!-/:-@\\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€\U0001f300-\U0001f64f"
PLAIN = re.compile(f"[{LETTERS}{NUMBERS}{BLANKS}{SIGNS}]*")
LONG_RUN = re.compile(f"[{BLANKS}]{{10000}}")  # whose end the fast splitter looks for on its stack, which a million blanks exhaust
# Fixed value: how a byte-level vocabulary's own splitter cuts a text into pieces, which are encoded one by one.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: the byte-level alphabet. Printable bytes stand for themselves, the others for the characters from 256 on.
PRINTABLE = (*range(33, 127), *range(161, 173), *range(174, 256))
BYTES = {b: b for b in PRINTABLE} | {256 + k: b for k, b in enumerate(b for b in range(256) if b not in PRINTABLE)}


def vocabulary() -> str:
    """The file of the default vocabulary, where the tokenizers' package is installed: each worker looks it up for itself."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ranks(path: str) -> dict[bytes, int] | None:
    """Identifiers by the bytes they stand for, if merging by identifier is what the file asks for, else None.

    It is where each merge makes a token of a larger identifier than the one before, from tokens that merges made as well:
    when a pair can be merged, all smaller merges inside it are done, whatever stands around it, so it is the pair that the token was made of.
    """
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, split = given["model"], given.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    if not plain or given.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
        return None
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    if any(a >= b for a, b in zip(made, made[1:], strict=False)):
        return None
    single = {t for t in model["vocab"] if len(t) == 1}
    special = {t["content"] for t in given.get("added_tokens", [])}
    if len(single) != 256 or set(model["vocab"]) - single - special - {"".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]}:
        return None
    return {bytes(map(BYTES.__getitem__, map(ord, t))): k for t, k in model["vocab"].items() if t not in special}


class Identifiers:
    """``packed(text)``: the text's identifiers, four little-endian bytes each, as the tokenizer of the file gives them.

    Where the file allows it, plain texts are encoded by the faster of the public libraries for such vocabularies. Texts with the
    tokenizer's special strings, characters beyond ``PLAIN`` or very long runs of blanks go to the tokenizer itself.
    """

    def __init__(self, path: str | None = None) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        path = path or vocabulary()
        self.tokenizer = Tokenizer.from_file(path)
        known = ranks(path)
        self.fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=known, special_tokens={}) if known else None
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def packed(self, text: str) -> bytes:
        if self.fast is None or not PLAIN.fullmatch(text) or (self.special and self.special.search(text)) or LONG_RUN.search(text):
            return self.encoded(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


_OF_FILE: dict[str, Identifiers] = {}


def identifiers(path: str | None = None) -> Identifiers:
    """A worker's own, kept from task to task."""
    path = path or vocabulary()
    if path not in _OF_FILE:
        _OF_FILE[path] = Identifiers(path)
    return _OF_FILE[path]
