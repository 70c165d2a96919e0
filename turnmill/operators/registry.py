"""What each resource lets a query select, filter and group, and how its rows are ordered."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Resource:
    """fields: public name -> (column, uses); uses has S (select), F (filter), G (group and metric), # (numeric)."""

    name: str
    fields: dict[str, tuple[str, str]]
    key: tuple[str, ...]
    time: str
    required: str | None = None
    payloads: frozenset[str] = field(default_factory=frozenset)

    def columns(self, use: str) -> dict[str, Column]:
        return {n: F.col(c) for n, (c, uses) in self.fields.items() if use in uses}


_COMMON = {"provider": ("provider", "SFG"), "projectKey": ("projectKey", "SFG"), "sessionKey": ("sessionKey", "SFG")}
_TURN = {"turnKey": ("turnKey", "SFG"), "observedAt": ("observedAt", "SFG")}

REGISTRY = {
    r.name: r
    for r in (
        Resource("session", _COMMON | {
            "session.startedAt": ("startedAt", "SG"), "session.endedAt": ("endedAt", "SG"), "originScope": ("originScope", "SFG"), "observedAt": ("endedAt", "FG"), "eligibility": ("eligibility", "SFG"),
            "duplicate.method": ("method", "SG"), "duplicate.confidence": ("confidence", "SG"), "duplicate.groupKey": ("groupKey", "SG"),
        }, ("sessionKey",), "endedAt"),
        Resource("turn", {"sessionKey": ("sessionKey", "SFG")} | _TURN | {
            "revision": ("revision", "SG"), "problem": ("problem", "S"), "finalAnswer": ("finalAnswer", "S"), "turn.providerTerminal": ("terminal", "SG"), "turn.visibility": ("visibility", "SFG"),
        }, ("turnKey",), "observedAt", payloads=frozenset({"problem", "finalAnswer"})),
        Resource("event", _COMMON | _TURN | {
            "eventKey": ("eventKey", "S"), "originScope": ("originScope", "SFG"), "completeness": ("completeness", "SFG"), "event.kind": ("kind", "SFG"), "capability.key": ("capabilityKey", "SFG"),
            "capability.canonicalName": ("capabilityName", "SFG"), "event.durationMs": ("durationMs", "SG#"), "event.exitCode": ("exitCode", "SG#"), "tool.input": ("input", "SF"), "tool.output": ("output", "S"), "error.content": ("error", "S"),
        }, ("eventKey",), "observedAt", payloads=frozenset({"tool.input", "tool.output", "error.content"})),
        Resource("capability-use", _COMMON | _TURN | {
            "useKey": ("useKey", "S"), "originScope": ("originScope", "SFG"), "capability.key": ("capabilityKey", "SFG"), "capability.canonicalName": ("capabilityName", "SFG"),
            "capability.kind": ("capabilityKind", "SFG"), "capability.observedName": ("capabilityName", "SG"), "attempt.chainKey": ("chainKey", "S"),
            "capability.terminalState": ("terminalState", "SFG"), "capability.inputFingerprint": ("inputFingerprint", "SG"), "capability.correlationDigest": ("correlationDigest", "SG"),
        }, ("useKey",), "observedAt"),
        Resource("file-activity", _COMMON | _TURN | {
            "eventKey": ("eventKey", "S"), "file.ordinal": ("activityOrdinal", "S"), "file.action": ("action", "SFG"), "file.normalizedPath": ("path", "SFG"),
            "file.phase": ("phase", "SFG"), "file.pathRole": ("pathRole", "SG"), "file.rawPath": ("rawPath", "SG"), "file.relativePath": ("relativePath", "SFG"), "file.absolute": ("absolute", "S"), "file.projectRelative": ("projectRelative", "S"),
        }, ("eventKey", "activityOrdinal"), "observedAt"),
        Resource("token-usage", _COMMON | _TURN | {
            "eventKey": ("eventKey", "S"), "token.scope": ("scope", "SG"), "token.model": ("model", "SFG"), "token.input": ("input", "SG#"), "token.cachedInput": ("cachedInput", "SG#"), "token.cacheWriteInput": ("cacheWriteInput", "SG#"),
            "token.output": ("output", "SG#"), "token.reasoning": ("reasoning", "SG#"), "token.total": ("total", "SG#"),
        }, ("eventKey",), "observedAt"),
        Resource("error-occurrence", _COMMON | _TURN | {
            "eventKey": ("eventKey", "S"), "error.signature": ("signature", "SFG"), "error.exitCode": ("exitCode", "SG#"), "error.providerState": ("providerState", "SFG"), "error.content": ("content", "S"),
            "capability.key": ("capabilityKey", "SFG"), "capability.canonicalName": ("capabilityName", "SFG"),
        }, ("eventKey",), "observedAt", payloads=frozenset({"error.content"})),
        Resource("delivery-edge", {
            "repositoryKey": ("repositoryKey", "SFG"), "fromKind": ("fromKind", "SFG"), "fromKey": ("fromKey", "SFG"), "toKind": ("toKind", "SFG"), "toKey": ("toKey", "SFG"), "relation": ("relation", "SFG"), "strength": ("strength", "SFG"),
            "source": ("source", "SFG"), "commitHash": ("fromKey", "SFG"), "edgeKey": ("edgeKey", "SF"), "reachable": ("reachable", "SFG"), "parentNo": ("parentNo", "SFG#"), "observedAt": ("observedAt", "SFG"),
        }, ("repositoryKey", "fromKey", "parentNo"), "observedAt", required="repositoryKey"),
    )
}
