"""The technique table and the order of tactics."""

from __future__ import annotations

#: Technique -> (name, tactic).
TECHNIQUES = {
    "T1110": ("Brute Force", "Credential Access"),
    "T1078": ("Valid Accounts", "Defense Evasion / Persistence"),
    "T1059.001": ("PowerShell", "Execution"),
    "T1136.001": ("Local Account", "Persistence"),
    "T1070.001": ("Clear Windows Event Logs", "Defense Evasion"),
    "T1543.003": ("Windows Service", "Persistence / Privilege Escalation"),
    "T1046": ("Network Service Discovery", "Discovery"),
    "T1190": ("Exploit Public-Facing Application", "Initial Access"),
    "T1087": ("Account Discovery", "Discovery"),
    "T1562.001": ("Impair Defenses", "Defense Evasion"),
    "T1053": ("Scheduled Task/Job", "Execution / Persistence"),
    "T1048": ("Exfiltration Over Alternative Protocol", "Exfiltration"),
}
#: The tactics in order.
TACTICS = (
    "Reconnaissance",
    "Resource Development",
    "Initial Access",
    "Execution",
    "Persistence",
    "Privilege Escalation",
    "Defense Evasion",
    "Credential Access",
    "Discovery",
    "Lateral Movement",
    "Collection",
    "Command and Control",
    "Exfiltration",
    "Impact",
)


def technique_info(technique: str | None) -> tuple[str, str]:
    """(name, tactic): Unmapped without a technique, a custom mapping where the table has none."""
    return TECHNIQUES.get(technique, ("Custom Mapping", "Unmapped")) if technique else ("Unmapped", "Unmapped")
