"""Settings from the environment, checked once when they are made."""

from __future__ import annotations

import ipaddress
import os
from collections.abc import Mapping
from dataclasses import dataclass, fields
from urllib.parse import urlsplit

LOCAL_SUFFIXES = (".local", ".internal", ".localhost", ".lan", ".home.arpa")
ACKNOWLEDGED = "I accept that documents leave this network"


def is_private(url: str) -> bool:
    """Whether a URL's host is in this network; `functions.text.is_private_endpoint` is the same for columns."""
    host = (urlsplit(url).hostname or "").lower()
    if not host:
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return "." not in host or host.endswith(LOCAL_SUFFIXES)
    return ip.is_private or ip.is_loopback or ip.is_link_local


@dataclass(frozen=True)
class Settings:
    index: str = "index"
    embed_url: str = ""
    rerank_url: str = ""
    llm_url: str = ""
    llm_key: str = ""
    require_local_llm: bool = False
    external_llm_ack: str = ""
    dimension: int = 64
    tokenizer: str = ""

    def __post_init__(self):
        if self.llm_url and not is_private(self.llm_url):
            if self.require_local_llm and self.external_llm_ack != ACKNOWLEDGED:
                raise ValueError("the model is outside this network, and settings ask for one inside")
            if not self.llm_key:
                raise ValueError("a model outside this network takes a key")

    @classmethod
    def from_env(cls, env: Mapping[str, str] = os.environ) -> Settings:
        kinds = {"bool": lambda x: x.lower() in ("1", "true", "yes"), "int": int, "str": str}
        return cls(**{f.name: kinds[str(f.type)](env[f"QUERN_{f.name.upper()}"]) for f in fields(cls) if f"QUERN_{f.name.upper()}" in env})

    @property
    def sovereignty(self) -> str:
        return "local" if not self.llm_url or is_private(self.llm_url) else "external"
