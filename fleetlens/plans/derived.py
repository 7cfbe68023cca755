"""Fleet inputs derived from the fixture tables.

Tables with no natural fleet counterpart (addresses, CIDRs, versions,
Java banners, log lines, tag text) are built from ids by arithmetic and
concatenation. Each derivation is one SQL expression that both Spark
SQL and DuckDB parse identically, so a query and its oracle start from
the same input. Spark evaluates them with ``F.expr`` on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(sql: str) -> Column:
    return F.expr(sql)


def octet(expr: str, shift: int) -> str:
    """Byte ``shift`` (0 = lowest) of a non-negative integer expression."""
    if shift == 0:
        return f"(({expr}) % 256)"
    return f"(CAST(floor(({expr}) / {256 ** shift}) AS BIGINT) % 256)"


def dotted(*parts: str) -> str:
    return "concat(" + ", '.', ".join(f"CAST({p} AS STRING)" for p in parts) + ")"


# Customer addresses (F4): private 10.x.y.z and public 54.n.y.z.
CUSTOMER_PRIVATE = "(c_acctbal < 0)"
CUSTOMER_PRIVATE_IP = dotted("10", octet("c_custkey", 2), octet("c_custkey", 1), octet("c_custkey", 0))
CUSTOMER_PUBLIC_IP = dotted("54", "c_nationkey", octet("c_custkey", 1), octet("c_custkey", 0))
CUSTOMER_PRIVATE_HOST = f"concat('ip-', replace({CUSTOMER_PRIVATE_IP}, '.', '-'), '.ec2.internal')"
CUSTOMER_PUBLIC_HOST = (f"concat('ec2-', replace({CUSTOMER_PUBLIC_IP}, '.', '-'), "
                        "'.compute-1.amazonaws.com')")

# Block devices from line items (F3, J2): the first line of an order is the
# root volume, sizes scale with the price, line 7 reports an unreadable size.
DEVICE_KNAME = "concat('/dev/xvd', CAST(l_linenumber AS STRING), '-', CAST(l_orderkey AS STRING))"
DEVICE_MOUNT = ("CASE WHEN l_linenumber = 1 THEN '/' WHEN l_linenumber = 2 THEN NULL "
                "ELSE concat('/media/d', CAST(l_linenumber AS STRING)) END")
DEVICE_SIZE = ("CASE WHEN l_linenumber = 7 THEN 'n/a' "
               "ELSE CAST(CAST(floor(l_extendedprice * 20000) AS BIGINT) AS STRING) END")

# Event flows (J5): source address 10.0.u.e from user and event ids, and a port.
FLOW_IP = f"(167772160 + {octet('user_id', 0)} * 256 + {octet('event_id', 0)})"
FLOW_PORT = "(8000 + event_id % 100)"

# Access rules (J5) from suppliers: a prefix length of 16, 20, 24 or 28 and
# the network that contains 10.0.(k*37 % 256).(k*11 % 256).
RULE_LEN = "(16 + (s_suppkey % 4) * 4)"
RULE_RAW = "(167772160 + ((s_suppkey * 37) % 256) * 256 + (s_suppkey * 11) % 256)"
RULE_NET = (f"(CAST(floor({RULE_RAW} / power(2, 32 - {RULE_LEN})) AS BIGINT) "
            f"* CAST(power(2, 32 - {RULE_LEN}) AS BIGINT))")
RULE_PORT_LO = "(8000 + (s_suppkey * 7) % 90)"
RULE_PORT_HI = f"({RULE_PORT_LO} + 5 + s_suppkey % 20)"
