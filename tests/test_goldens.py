"""Ids of texts and entities against those that the given fixtures list."""

import re

import pytest
from conftest import ROOT, given_prefixes

from linkframe.functions.hashing import id_of, resource_id

PREFIXES = given_prefixes()
ROWS = re.findall(r"^\| (.+?) \| (`[\w-]{11}`.*?) \|$", (ROOT / "FIXTURES.md").read_text() if PREFIXES else "", re.M)


def full(name: str) -> str:
    short, colon, rest = name.partition(":")
    return PREFIXES[short] + rest if colon and short in PREFIXES else name


@pytest.mark.skipif(not ROWS, reason="the given fixtures are not there")
def test_listed_ids():
    texts = entities = 0
    for what, ids in ROWS:
        ids = re.findall(r"`([\w-]{11})`", ids)
        if all(re.fullmatch('`[^`]+`|`""`', x) for x in what.split(" / ")) and "," not in what:
            for x, want in zip(what.split(" / "), ids):
                assert id_of("" if x == '`""`' else x.strip("`")) == want
                texts += 1
        elif m := re.fullmatch(r"`?([^`,]+?)`?, ((?:\w+=[^,]+(?:, )?)+)", what):
            etype = full(m[1])
            space = re.match(r".*[/#]", etype)[0]
            pairs = [(space + k, v) for k, v in (x.split("=", 1) for x in m[2].split(", "))]
            assert resource_id(pairs, etype) == ids[0], what
            entities += 1
    assert texts >= 6 and entities >= 6
