"""Registrable domain, public suffix and subdomain of host names.

The rules are a public suffix list.  ``SMALL_LIST`` holds a few common suffixes;
pass the lines of a full list for real work.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Some rules of the public suffix list.
SMALL_LIST = (
    "com net org edu gov mil int info biz name io co ai app dev me tv cc us uk co.uk org.uk ac.uk gov.uk me.uk de fr es it nl be ch "
    "at se no fi dk pl cz ru cn com.cn net.cn org.cn jp co.jp ne.jp or.jp ac.jp go.jp kr co.kr or.kr in co.in br com.br au com.au "
    "net.au org.au nz co.nz ca mx com.mx za co.za tr com.tr sg com.sg hk com.hk tw com.tw *.ck !www.ck github.io blogspot.com"
).split()


@dataclass(frozen=True)
class SuffixList:
    """Rules of a public suffix list, wildcards and exceptions included."""

    rules: frozenset[str]
    version: str = "small"

    @classmethod
    def of(cls, lines: list[str], version: str = "file") -> SuffixList:
        kept = (line.split()[0].lower() for line in lines if line.strip() and not line.lstrip().startswith("//"))
        return cls(frozenset(rule.encode("idna").decode() if not rule.isascii() and "*" not in rule else rule for rule in kept), version)

    def split(self, host: str | None) -> tuple[str, str, str]:
        """Registrable domain, suffix and subdomain, all empty where no rule holds."""
        labels = (host or "").strip(" \t\n\r\f").lower().removesuffix(".").split(".")
        if not all(labels):
            return "", "", ""
        size = 0
        for k in range(len(labels)):
            rest = ".".join(labels[k:])
            if "!" + rest in self.rules:
                size = len(labels) - k - 1
                break
            if rest in self.rules or "*." + ".".join(labels[k + 1 :]) in self.rules:
                size = len(labels) - k
                break
        if not size or size >= len(labels):
            return "", "", ""
        return ".".join(labels[-size - 1 :]), ".".join(labels[-size:]), ".".join(labels[: -size - 1])


def default_list() -> SuffixList:
    return SuffixList(frozenset(SMALL_LIST))


def parts(column: Column, suffixes: SuffixList | None = None) -> Column:
    """A struct of ``registrable``, ``suffix`` and ``subdomain``.  Each distinct host of a batch is split once."""
    known = suffixes or default_list()

    @F.pandas_udf("registrable string, suffix string, subdomain string")
    def split(hosts: pd.Series) -> pd.DataFrame:
        distinct = {h: known.split(h) for h in hosts.unique()}
        return pd.DataFrame([distinct[h] for h in hosts], columns=["registrable", "suffix", "subdomain"])

    return split(column.cast("string"))


def host(column: Column) -> Column:
    """The host of a URL, lower-cased, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(column.cast("string"), r"\A[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#@]+)", 1))


def host_of(url: str) -> str:
    return urlsplit(url).hostname or ""
