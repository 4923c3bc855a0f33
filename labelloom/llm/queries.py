"""The registered queries of the subpackage."""

from labelloom.llm import bpe, chat, common, digest, importance, langid, mixing, mtree, negatives, packing, simhash, toxicity, unigram, urls  # noqa: F401


def all_queries():
    return dict(common.QUERIES)


def all_oracles():
    return dict(common.ORACLES)
