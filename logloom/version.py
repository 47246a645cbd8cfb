"""Version of this library."""

from __future__ import annotations

import json
import platform

VERSION = "0.2.0"


def version_text(output: str = "", short: bool = False) -> str:
    """Version as text, ``json`` or ``yaml``; ValueError for another format."""
    data = {"version": VERSION, "python": platform.python_version(), "os": platform.system().lower(), "arch": platform.machine()}
    if short:
        return VERSION
    if output == "json":
        return json.dumps(data, indent=2)
    if output == "yaml":
        return "".join(f"{k}: {v}\n" for k, v in data.items())
    if output:
        raise ValueError(f"unsupported output format {output!r}")
    return f"logloom {VERSION} (python {data['python']}, {data['os']}/{data['arch']})"
