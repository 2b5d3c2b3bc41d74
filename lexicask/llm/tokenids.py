"""Token ids of whole texts by a public tokenizer file, as packed little-endian unsigned 32-bit ids."""

from __future__ import annotations

import json
import os
import re
from array import array

import pyarrow as pa

from lexicask.llm.common import text_buffer

#: Distinct chunks whose ids a worker remembers before the older half of them is forgotten: bounded for any corpus.
MEMORY = 900_000
#: Letters of ISO 8859-1 in UTF-8, lower case, and digits; fixed values.
LETTER = rb"[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
#: A run of ASCII marks between such a character and white space: a token of its own to this tokenizer's rules.
MARKED = re.compile(rb"[!-/:-@[-`{-~](?:(?<=[a-z0-9][!-/:-@[-`{-~])|(?<=\xc3[\x80-\x96\x98-\xb6\xb8-\xbf][!-/:-@[-`{-~]))[!-/:-@[-`{-~]*(?=[ \t-\r]|\Z)")
#: Chunks that are one word and need no normalising but lower case.
PLAIN = re.compile(rb"(?:" + LETTER + rb")+")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_letters() -> dict[int, str]:
    """The printable letter that a byte-level vocabulary writes for each byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


#: The rules of word_bpe_49k.json, which lower-cases texts, drops white space and never joins text across it.
RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "truncation": None,
    "padding": None,
}


def has_rules(tokenizer) -> bool:
    """Whether a tokenizer has RULES, and nothing but strings of the form <|...|> beside its vocabulary."""
    own = json.loads(tokenizer.to_str())
    added = all(t["content"].startswith("<|") and t["content"].endswith("|>") and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in own["added_tokens"])
    return added and all(own.get(k) == v for k, v in RULES.items()) and own["model"]["type"] == "BPE" and not own["model"].get("dropout")


class Known(dict):
    """What `learn` gives for each key that was asked for: one look-up for a chunk that is known."""

    def __init__(self, learn):
        super().__init__()
        self.learn = learn

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self[chunk] = self.learn(chunk)
        return ids


class Tokens:
    """Ids of texts by a tokenizer file, as the tokenizer itself gives them with add_special_tokens=False.

    Under a file without RULES every text goes to the tokenizer whole. Under one with them a text is lower-cased (A-Z), its marks at ends of words are set apart, it is cut at ASCII white space, and each chunk's ids
    are remembered. An unknown chunk of plain letters goes to the tokenizer's BPE model, any other through the whole tokenizer. A text with "<|", where case decides whether a special
    token stands, is cut as it is.
    """

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_path())
        self.model = self.tokenizer.model
        self.by_chunks = has_rules(self.tokenizer)
        letters = byte_letters()
        self.letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        self.four = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.known, self.older = Known(self._learn), {}

    def _learn(self, chunk: bytes) -> bytes:
        """Packed ids of a chunk that is not in the memory, or in its older half."""
        if chunk in self.older:
            return self.older[chunk]
        if chunk.isalpha() and chunk.islower():  # of bytes: ASCII letters
            return b"".join([self.four[t.id] for t in self.model.tokenize(chunk.decode())])
        if PLAIN.fullmatch(chunk):
            return b"".join([self.four[t.id] for t in self.model.tokenize(chunk.decode().lower().translate(self.letters))])
        return array("I", self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def of_texts(self, texts: list[bytes], end: int) -> list[bytes]:
        """Packed ids of each UTF-8 text, with the id `end` after it."""
        tail, out = end.to_bytes(4, "little"), []
        if not self.by_chunks:
            for text in texts:  # one at a time: a batch's ids need many times the memory of its texts
                out.append(array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes() + tail)
            return out
        for text in texts:
            text = text if b"<|" in text else MARKED.sub(rb" \g<0>", text.lower())
            if len(self.known) > MEMORY:
                self.known, self.older = Known(self._learn), dict(self.known)
            out.append(b"".join(map(self.known.__getitem__, text.split())) + tail)
        return out

    def of_column(self, column: pa.Array, end: int) -> list[bytes]:
        """As of_texts, for a string column; null is the empty text."""
        data, starts = text_buffer(column)
        data, starts = data.tobytes(), starts.tolist()
        return self.of_texts([data[a : b - 1] for a, b in zip(starts, starts[1:])], end)


_TOKENS: dict[str, Tokens] = {}


def tokens(path: str | None = None) -> Tokens:
    """The worker's own Tokens, kept between tasks."""
    path = path or default_path()
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]
