"""Bloom queries over all reads, odd ids included."""

import hashlib

from strandline.plans import queries

SF = "/root/testdata/sf0.01"


def slots(s):
    return {int(hashlib.md5(f"{s}#{seed}".encode()).hexdigest()[:15], 16) % 50_000 for seed in range(5)}


def test_bits_of_every_read(spark):
    strands = [r.s for r in queries.reads(spark, SF).select("s").collect()]
    bits = {r.bit for r in queries.QUERIES["bloom_bits"](spark, SF).collect()}
    assert bits == set().union(*map(slots, strands)) and len(bits) == 4_755  # as in SURVEY 7.4


def test_every_read_is_found(spark):
    got = queries.QUERIES["bloom_probe"](spark, SF)
    assert got.where("member").count() == got.where("not member").count() == 1_000
    assert got.where("member and not maybe").count() == 0 and got.where("not member and maybe").count() < 25
