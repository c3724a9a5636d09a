"""The driver's machine and its log."""

from __future__ import annotations

import logging
import os
import platform
import sys
from pathlib import Path

#: Names of levels.
_LEVELS = {"debug": logging.DEBUG, "info": logging.INFO, "warning": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL}


def log_level(name: str) -> int:
    """By name in any case; anything else is INFO."""
    return _LEVELS.get(str(name).lower(), logging.INFO)


def logger(name: str, path: str | None = None, level: str = "info") -> logging.Logger:
    """A logger to the console, and to a file as well if a path is given; handlers of an earlier call are closed."""
    out = logging.getLogger(name)
    for h in list(out.handlers):
        out.removeHandler(h)
        h.close()
    handlers: list[logging.Handler] = [logging.StreamHandler(sys.stdout)]
    if path:
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        handlers.append(logging.FileHandler(path))
    for handler in handlers:
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        out.addHandler(handler)
    out.setLevel(log_level(level))
    out.propagate = False
    return out


def _physical_cores() -> str:
    """From the kernel's processor list: different (socket, core) pairs."""
    try:
        blocks = Path("/proc/cpuinfo").read_text().strip().split("\n\n")
    except OSError:
        return "Unknown"
    fields = [dict(tuple(x.strip() for x in line.split(":", 1)) for line in b.splitlines() if ":" in line) for b in blocks]
    pairs = {(f["physical id"], f["core id"]) for f in fields if "physical id" in f and "core id" in f}
    return str(len(pairs)) if pairs else "Unknown"


def _frequency() -> str:
    """The highest clock that the kernel knows of, else the highest at the moment."""
    try:
        return f"{int(Path('/sys/devices/system/cpu/cpu0/cpufreq/cpuinfo_max_freq').read_text()) // 1000} MHz"
    except (OSError, ValueError):
        pass
    try:
        clocks = [float(line.split(":")[1]) for line in Path("/proc/cpuinfo").read_text().splitlines() if line.startswith("cpu MHz")]
    except (OSError, ValueError):
        clocks = []
    return f"{max(clocks):.0f} MHz" if clocks else "Unknown"


def machine() -> dict[str, str]:
    """CPU, threads, physical cores, frequency, memory, system and Python of the driver; what cannot be told is "Unknown"."""
    try:
        memory = f"{os.sysconf('SC_PAGE_SIZE') * os.sysconf('SC_PHYS_PAGES') / 2**30:.1f} GB"
    except (ValueError, OSError):
        memory = "Unknown"
    return {"cpu": platform.processor() or platform.machine() or "Unknown", "cores": str(os.cpu_count() or "Unknown"), "physical_cores": _physical_cores(), "frequency": _frequency(), "memory": memory, "system": platform.platform() or "Unknown", "python": platform.python_version()}


def log_machine(to: logging.Logger) -> None:
    for name, value in machine().items():
        to.info("%s: %s", name, value)
