"""Stand-ins for a language model and an encoder, for tests and registered queries.

They are test doubles: deterministic functions of the request, simple enough to
be written in SQL as well.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd

from labelloom.operators.inference import Backend, register_backend

_TARGET = re.compile(r"approximately (\d+) words")


def _reply(prompt: str | None, messages) -> str:
    if prompt is not None:
        k = int(_TARGET.search(prompt).group(1))
        return "  " + " ".join(_post(prompt, messages).split()[:k]) + "\n"
    body = messages[-1]["content"]
    names = [line[2:] for line in body.split("Categories:\n", 1)[1].split("\n\n", 1)[0].split("\n")]
    text = _post(prompt, messages)
    h = hashlib.sha1(text.encode()).hexdigest()
    if h[0] == "0":
        return "I am not sure"
    if h[0] == "1":
        return '{"category": "none of these"}'
    return '{"category": "' + names[int(h[1:5], 16) % len(names)] + '"}'


def _post(prompt: str | None, messages) -> str:
    if prompt is not None:
        return prompt.split("POST:\n", 1)[1].rsplit("\n\nSUMMARY:", 1)[0]
    return messages[-1]["content"].rsplit("POST:\n", 1)[1].rsplit("\n\n", 1)[0]


def lead_words(batches):
    """Summaries are the leading words; classes follow the digest of the text, a few replies do not parse.

    Every character of the post and of the reply counts as a token.
    """
    for pdf in batches:
        content = [_reply(p, m) for p, m in zip(pdf["prompt"], pdf["messages"])]
        asked = [len(_post(p, m)) for p, m in zip(pdf["prompt"], pdf["messages"])]
        yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": content, "input_tokens": asked, "output_tokens": [len(c) for c in content]})


def dropping(batches):
    """As lead_words, but loses the requests whose id begins with 0, 1, 2 or 3."""
    for pdf in lead_words(batches):
        yield pdf[~pdf["custom_id"].str[0].isin(list("0123"))]


def window_teller(batches):
    """Replies name the request's context window, and how many windows the task has seen so far."""
    seen = set()
    for pdf in batches:
        seen.update(pdf["num_ctx"].tolist())
        yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": [f"{n}|{len(seen)}" for n in pdf["num_ctx"]]})


def digest_encoder(batches):
    """Eight numbers from the MD5 of the text."""
    for pdf in batches:
        rows = [np.frombuffer(hashlib.md5(t.encode()).digest(), dtype=np.uint8)[:8].astype(np.float32) for t in pdf["text"]]
        yield pd.DataFrame({"cache_key": pdf["cache_key"], "embedding": rows})


TAG = "double:lead-words"


def lead_backend(**settings) -> Backend:
    return Backend("lead_words", lead_words, **settings)


register_backend("lead_words", lead_backend)
