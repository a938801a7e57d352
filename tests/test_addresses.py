"""T24's verdicts of literal addresses equal Python's, on 10,000 of them; T14 in linear time."""

import ipaddress
import random
import time

from pyspark.sql import functions as F

from millrace.functions import html, text

ODD = ["100::1", "2001:2::1", "64:ff9b:1::1", "2001:10::1", "0:0:0:0:0:0:0:1", "::", "::ffff:1.2.3.4", "::1.2.3.4", "2001:4:112::7", "fe80::1%eth0", "1::2::3", ":::", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "12345::", "g::", ":1::", "1::2:", "::1.2.3", "::01.2.3.4", "1.2.3.4::", "010.0.0.1", "256.1.1.1", "1.2.3", "1.2.3.4.5", "example.org", ""]


def _refused(host):
    try:
        ip = ipaddress.ip_address(host.split("%")[0])
    except ValueError:
        return False
    return not ip.is_global or ip.is_multicast or ip.is_unspecified


def test_addresses(spark):
    rng, made = random.Random(9), list(ODD)
    blocks = [ipaddress.ip_network(b) for b in (*html.PRIVATE4, *html.GLOBAL4, *html.SHARED4, *html.MULTICAST4, *html.PRIVATE6, *html.GLOBAL6, *html.MULTICAST6)]
    for block in blocks:
        size = block.max_prefixlen
        for edge in (int(block.network_address), int(block.broadcast_address)):
            made += [str(type(block.network_address)(n)) for n in (edge - 1, edge, edge + 1) if 0 <= n < 1 << size]
    while len(made) < 10_000:
        block = rng.choice(blocks)
        made.append(str(block[rng.randrange(min(block.num_addresses, 1 << 60))]))
        made.append(str(ipaddress.IPv6Address(rng.getrandbits(128) >> rng.choice([0, 8, 64, 96]))))
        made.append(ipaddress.IPv6Address(rng.getrandbits(128)).exploded)
        made.append(f"::ffff:{ipaddress.IPv4Address(rng.getrandbits(32))}")
        made.append(str(ipaddress.IPv4Address(rng.getrandbits(32))))
    table = spark.createDataFrame(list(enumerate(made)), "i int, host string")
    got = {r.i: (r.refused, r.six) for r in table.select("i", html.refused_address(F.col("host")).alias("refused"), html.ipv6_hex(F.col("host")).alias("six")).collect()}
    assert {made[i]: got[i][0] for i in got} == {h: _refused(h) for h in made}
    for i, host in enumerate(made):
        try:
            six = f"{int(ipaddress.IPv6Address(host.split('%')[0])):032x}"
        except ValueError:
            six = None
        assert got[i][1] == six, host


def test_unwrap_takes_linear_time(spark):
    line = "some words of a line that is as long as lines are in plain text\n"
    tables = [spark.createDataFrame([(line * n,)], "t string").cache() for n in (4_000, 16_000)]
    took = []
    for table in (tables[0], *tables):
        began = time.perf_counter()
        assert table.select(F.length(text.unwrap_soft_lines(F.col("t")))).first()[0] > 100_000
        took.append(time.perf_counter() - began)
    assert took[2] < 12 * max(took[1], 0.2)
