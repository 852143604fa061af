"""Addresses and ports: private ranges, schemes, and what a request may reach."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that requests must not reach, and ports they may.
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "0.0.0.0/8")
PORTS = (80, 443, 8080, 8443)


def number(ip: Column) -> Column:
    """IPv4 as a number, or null."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})$")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, p: a * 256 + p.try_cast("long"))
    return F.when(ok, value)


def private(ip: Column) -> Column:
    n, out = number(ip), F.lit(False)
    for net in map(ipaddress.ip_network, PRIVATE):
        out = out | n.between(int(net.network_address), int(net.broadcast_address))
    return F.coalesce(out, F.lit(False))
