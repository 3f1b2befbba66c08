"""Public vocabularies as encoders."""

from __future__ import annotations

import base64
import json
from collections.abc import Callable

#: Same ids as byte_bpe_50k.json, from a faster library; the tests compare both.
#: Added tokens are read from the JSON.
VOCABULARY = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_ranks(path: str) -> dict[bytes, int]:
    """Bytes of the tokens of a rank file, and their ids."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


def byte_encoder(path: str | None = None, plain: bool = False) -> Callable[[str], list[int]]:
    """The byte-level vocabulary as an encoder. Added tokens of the JSON vocabulary beside it are
    found inside texts, as by ``tokenizers`` (also with ``add_special_tokens=False``), unless ``plain``
    makes them ordinary text.

    The faster library's patterns give up on runs of about a million white-space characters; such a
    text goes to ``tokenizers`` and the JSON, which give the same ids.
    """
    import public_tokenizers
    import tiktoken

    path = path or vocabulary_path()
    slow_path = path.removesuffix(".tiktoken") + ".json"
    with open(slow_path, encoding="utf-8") as file:
        added = {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN,
                                 mergeable_ranks=byte_ranks(path),
                                 special_tokens={} if plain else added)
    slow = []

    def encode(text: str) -> list[int]:
        try:
            return encoding.encode(text, allowed_special="all")
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer

                slow.append(Tokenizer.from_file(slow_path))
                slow[0].encode_special_tokens = plain
            return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def byte_token_bytes(path: str | None = None) -> list[bytes]:
    """The bytes of each id of the byte-level vocabulary."""
    ranks = byte_ranks(path or vocabulary_path())
    out = [b""] * (max(ranks.values()) + 1)
    for data, i in ranks.items():
        out[i] = data
    return out


def piece_encoder(path: str | None = None) -> tuple[Callable[[list[str]], list[list[int]]], list[bytes]]:
    """The piece vocabulary as an encoder of lists of texts, and the bytes of each id: the piece in
    UTF-8 with U+2581 as space, or the one byte that a byte piece stands for."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path or vocabulary_path(PIECES))
    data = [bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i)
            else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.get_piece_size())]
    return lambda texts: model.encode(texts, num_threads=1), data
