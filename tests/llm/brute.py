"""Plain versions of the operators, over small inputs."""

from __future__ import annotations

import hashlib
import re

_ASSIGN = re.compile(r"""(?P<k>password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<v>[A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m["v"]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def base_secrets_sha256(text):
    names = ["assign", "access", "hex"]
    return hashlib.sha256(",".join(f"{names[k]}:{a}:{b}" for a, k, b in base_secrets(text)).encode()).hexdigest()
