"""Settings with defaults. A text in TOML overrides them section by section; keys that are not known are ignored,
so that settings written for a later version still load."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields, replace

# The defaults of all sections.


@dataclass(frozen=True)
class Repository:
    slug: str = ""
    default_branch: str = "main"
    clone_url: str = ""
    toolchain: str = ""
    package_roots: tuple[str, ...] = ()
    system_binaries: tuple[str, ...] = ()
    watch: bool = True
    max_prs: int = 25


@dataclass(frozen=True)
class Budget:
    total_usd: float = 100.0
    per_run_usd: float = 0.25
    per_repo_daily_usd: float = 2.0
    warn_at_fraction: float = 0.8


@dataclass(frozen=True)
class Models:
    max_tokens: int = 8192
    cache_ttl: str = "1h"
    enabled: str = "auto"
    max_adjudications: int = 8
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Sandbox:
    max_concurrent: int = 0
    default_timeout_s: int = 300
    default_memory_mb: int = 1024
    pids_limit: int = 256
    cpus: float = 1.0
    tmpfs_size_mb: int = 256
    outer_grace_s: int = 30
    max_log_lines: int = 50_000
    max_log_bytes: int = 8 << 20
    sample_interval_s: float = 1.0


@dataclass(frozen=True)
class Limits:
    """From where on a change of a self-description counts as notable or major."""

    api_removed_major_fraction: float = 0.2
    api_removed_major_count: int = 10
    api_added_notable_fraction: float = 0.3
    purpose_major_similarity: float = 0.6
    purpose_notable_similarity: float = 0.9
    webhook_min_level: str = "major"
    refresh_on_branch_move: bool = True


@dataclass(frozen=True)
class Harvest:
    harvest_limit: int = 200
    incremental_limit: int = 100
    unauthenticated_limit: int = 15
    refresh_hours: float = 24.0
    min_support: int = 3
    min_reviewers: int = 2
    max_comments: int = 1500


@dataclass(frozen=True)
class Serving:
    poll_interval_s: int = 120
    event_retention_days: int = 7
    debounce_s: int = 30
    max_queue_depth: int = 200


@dataclass(frozen=True)
class Settings:
    repos: tuple[Repository, ...] = ()
    budget: Budget = Budget()
    models: Models = Models()
    sandbox: Sandbox = Sandbox()
    charter: Limits = Limits()
    brain: Harvest = Harvest()
    server: Serving = Serving()

    @property
    def limits(self) -> Limits:
        return self.charter

    def __getattr__(self, name: str):
        """A value of whichever section has it."""
        if not name.startswith("_"):
            for f in fields(self):
                section = getattr(self, f.name)
                if hasattr(type(section), "__dataclass_fields__") and name in type(section).__dataclass_fields__:
                    return getattr(section, name)
        raise AttributeError(name)

    def repo(self, slug: str) -> Repository:
        """The repository's own settings; defaults for one that is not named."""
        return next((r for r in self.repos if r.slug == slug), Repository(slug))


def _names(value: object) -> tuple[str, ...]:
    return (value,) if isinstance(value, str) else tuple(map(str, value)) if isinstance(value, list) else ()


def _over(section, said: object):
    """A section with the values that a table states for its fields."""
    table = said if isinstance(said, dict) else {}
    stated = {f.name: table[f.name] for f in fields(section) if f.name in table}
    if "prices" in stated:
        pairs = stated["prices"] if isinstance(stated["prices"], dict) else {}
        good = {str(k): (float(p[0]), float(p[1])) for k, p in pairs.items() if isinstance(p, (list, tuple)) and len(p) == 2}
        stated["prices"] = section.prices | good
    for name in {"package_roots", "system_binaries"} & stated.keys():
        stated[name] = _names(stated[name])
    return replace(section, **stated)


def load(text: str = "", defaults: Settings = Settings()) -> Settings:
    """Settings of a TOML text over the defaults. Values may also stand without their section, and the charter's as
    [limits]. A single [target], as the first version wrote it, counts as a repository unless it is listed as one."""
    data = tomllib.loads(text)
    table = lambda name: data[name] if isinstance(data.get(name), dict) else {}
    data["charter"] = table("limits") | table("charter")
    listed = [_over(Repository(), r) for r in data.get("repos") or [] if isinstance(r, dict) and r.get("slug")]
    target = data.get("target")
    if isinstance(target, dict) and target.get("slug") and all(r.slug != target["slug"] for r in listed):
        listed.append(_over(Repository(), {**target, "package_roots": target.get("package_root")}))
    sections = {f.name: _over(getattr(defaults, f.name), data | table(f.name)) for f in fields(Settings) if f.name != "repos"}
    return Settings(repos=tuple(listed) or defaults.repos, **sections)
