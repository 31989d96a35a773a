"""Scenarios: templates of techniques and kinds of chains, matched against what each scope shows."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_TECHNIQUE = re.compile(r"T\d{4}(\.\d{3})?")


@dataclass(frozen=True)
class Template:
    """What a scenario needs; without ``kinds``, chains of any kind support it."""

    id: str
    name: str
    required: tuple[str, ...]
    optional: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    stage: str = "unknown"

    def __post_init__(self):
        if not (self.id and self.name and self.required):
            raise ValueError(f"template {self.id!r} lacks an id, a name or required techniques")
        for part in ("required", "optional"):
            object.__setattr__(self, part, tuple(str(t).strip().upper() for t in getattr(self, part)))


# The built-in templates.
BUILT_IN = tuple(
    Template(id, name, required, optional, kinds, stage)
    for id, name, required, optional, kinds, stage in (
        ("phishing_backdoor", "Phishing and backdoor", ("T1566", "T1059.001"), ("T1547.001", "T1053.005"), ("download_exec", "encoded_exec"), "initial_access"),
        ("encoded_cred_dump", "Encoded credential dump", ("T1059.001",), ("T1003",), ("encoded_exec",), "credential_access"),
        ("download_c2", "Download and command channel", ("T1105", "T1071"), ("T1059.001",), ("download_exec", "network_data"), "command_and_control"),
        ("wmi_lateral", "Lateral movement by WMI", ("T1047",), ("T1021",), (), "lateral_movement"),
        ("registry_persistence", "Persistence in the registry", ("T1547.001",), ("T1059.001", "T1053.005"), (), "persistence"),
        ("scheduled_task_execution", "Scheduled task", ("T1053.005",), ("T1059.001", "T1547.001"), (), "execution"),
        ("bits_data_transfer", "Transfer by BITS", ("T1197",), ("T1105", "T1071"), ("network_data",), "command_and_control"),
        ("rdp_lateral", "Lateral movement by remote desktop", ("T1021.001",), ("T1078", "T1003"), (), "lateral_movement"),
        ("fileless_attack", "Fileless attack", ("T1059.001",), ("T1218.005", "T1055"), ("encoded_exec",), "defense_evasion"),
        ("credential_dumping", "Credential dumping", ("T1003",), ("T1059.001", "T1047"), (), "credential_access"),
        ("service_creation", "Service creation", ("T1543.003",), ("T1059.001", "T1547.001"), (), "persistence"),
    )
)


def _listed(value) -> tuple[str, ...]:
    return tuple(map(str, value)) if isinstance(value, list) else (str(value),) if value else ()


def template_of(mapping: dict) -> Template:
    """A template of its mapping in a template file."""
    return Template(
        str(mapping.get("template_id") or mapping.get("id") or ""), str(mapping.get("name") or mapping.get("title") or ""), _listed(mapping.get("required_techniques")),
        _listed(mapping.get("optional_techniques")), _listed(mapping.get("chain_patterns")), str(mapping.get("attack_stage") or "unknown"),
    )


def satisfied_by(required: str, known: Sequence[str]) -> list[str]:
    """Those of the known techniques that meet a requirement: itself, or any part of it if it is a whole technique."""
    parent = bool(_TECHNIQUE.fullmatch(required)) and "." not in required
    return [t for t in known if t == required or parent and _TECHNIQUE.fullmatch(t) and t.startswith(f"{required}.")]


def _scenario(template: Template) -> Column:
    """The scenario of a row (techniques, kinds, n_findings), null where a requirement isn't met or no chain supports it."""
    known = list(dict.fromkeys((*template.required, *template.optional)))
    seen = F.array_intersect("techniques", F.array(*map(F.lit, known)))
    fits = lambda kind: kind.isin(*template.kinds) if template.kinds else F.lit(True)
    n_chains = F.aggregate(F.filter("kinds", lambda k: fits(k["kind"])), F.lit(0).cast("long"), lambda acc, k: acc + k["n"])
    met = n_chains > 0
    for required in template.required:
        met = met & F.arrays_overlap(seen, F.array(*map(F.lit, satisfied_by(required, known))))

    def share(part: tuple[str, ...]) -> Column:
        return sum((F.array_contains("techniques", t).cast("int") for t in part), F.lit(0)) / max(1, len(part))

    confidence = 0.3 + 0.3 * share(template.required) + 0.2 * share(template.optional) + F.least(F.lit(0.2), n_chains * 0.1) + F.least(F.lit(0.1), F.col("n_findings") * 0.02)
    return F.when(
        met,
        F.struct(
            F.lit(template.id).alias("template_id"), F.lit(template.name).alias("name"), F.lit(template.stage).alias("stage"), F.sort_array(seen).alias("techniques"),
            n_chains.alias("n_chains"), "n_findings", F.round(F.least(F.lit(1.0), confidence), 6).alias("confidence"),
        ),
    )


def infer(chains: DataFrame, findings: DataFrame, templates: Sequence[Template], scope: Sequence[str]) -> DataFrame:
    """Scenarios of each scope, from its chains (scope, kind) and findings (scope, technique).

    Both sides are folded to counts by kind and by technique first, so a scope is one row whose size is
    bounded by the number of kinds and techniques; templates are compiled to columns over that row. A scope
    without chains or without findings, or with a null part, has no scenario.
    """
    by_kind = chains.groupBy(*scope, "kind").agg(F.count("*").alias("n")).groupBy(*scope).agg(F.collect_list(F.struct("kind", "n")).alias("kinds"))
    by_technique = findings.groupBy(*scope, F.upper("technique").alias("technique")).agg(F.count("*").alias("n"))
    observed = by_technique.groupBy(*scope).agg(F.collect_set("technique").alias("techniques"), F.sum("n").alias("n_findings"))
    both = by_kind.join(observed, list(scope))
    return both.select(*scope, F.inline(F.array_compact(F.array(*map(_scenario, templates)))))
