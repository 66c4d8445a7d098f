"""The event rules that come with the library."""

from __future__ import annotations

from tracehound.operators.rules import Rule

_PROCESS = {"category": "process_creation"}

#: Titles, levels, techniques, fields and texts of the rules.
BUILT_IN = (
    Rule("PowerShell Encoded Command Execution", {"selection": {"Image|endswith": "\\powershell.exe", "CommandLine|contains": [" -enc ", " -EncodedCommand ", " -e "]}, "condition": "selection"}, "high", ["attack.execution", "attack.t1059.001"], _PROCESS),
    Rule("PowerShell Download Cradle", {"selection": {"CommandLine|contains": ["Net.WebClient", "DownloadString", "DownloadFile", "DownloadData", "Invoke-WebRequest", "IEX (New-Object"]}, "condition": "selection"}, "high", ["attack.command_and_control", "attack.t1059.001"], _PROCESS),
    Rule("LSASS Memory Dump via Comsvcs", {"selection": {"CommandLine|contains|all": ["comsvcs.dll", "MiniDump"]}, "condition": "selection"}, "critical", ["attack.credential_access", "attack.t1003.001"], _PROCESS),
    Rule("Suspicious Rundll32 Execution", {"selection": {"Image|endswith": "\\rundll32.exe", "CommandLine|contains": ["javascript:", "url.dll", "mshtml", "RunHTMLApplication"]}, "condition": "selection"}, "high", ["attack.defense_evasion", "attack.t1218.011"], _PROCESS),
    Rule("Shadow Copy Deletion", {"selection_vssadmin": {"CommandLine|contains|all": ["vssadmin", "delete", "shadows"]}, "selection_wmic": {"CommandLine|contains|all": ["shadowcopy", "delete"]}, "condition": "selection_vssadmin or selection_wmic"}, "critical", ["attack.impact", "attack.t1490"], _PROCESS),
    Rule("Windows Defender Tampering", {"selection": {"CommandLine|contains": ["Set-MpPreference -DisableRealtimeMonitoring", "Add-MpPreference -ExclusionPath", "Set-MpPreference -DisableBehaviorMonitoring", "Set-MpPreference -DisableIOAVProtection"]}, "condition": "selection"}, "high", ["attack.defense_evasion", "attack.t1562.001"], _PROCESS),
    Rule("Office Application Spawning Script Interpreter", {"selection": {"ParentImage|endswith": ["\\winword.exe", "\\excel.exe", "\\powerpnt.exe", "\\outlook.exe"], "Image|endswith": ["\\cmd.exe", "\\powershell.exe", "\\wscript.exe", "\\cscript.exe", "\\mshta.exe"]}, "condition": "selection"}, "high", ["attack.execution", "attack.t1566.001"], _PROCESS),
    Rule("Service Installation From Suspicious Location", {"selection": {"ServiceFileName|contains": ["\\Temp\\", "\\AppData\\", "\\ProgramData\\", "\\Users\\Public\\"]}, "condition": "selection"}, "high", ["attack.persistence", "attack.t1543.003"], {"category": "service_creation"}),
    Rule("Registry Run Key Persistence From Suspicious Path", {"selection": {"TargetObject|contains": "CurrentVersion\\Run", "Details|contains": ["\\Temp\\", "\\AppData\\", "\\Users\\Public\\", "powershell", "cmd.exe"]}, "condition": "selection"}, "high", ["attack.persistence", "attack.t1547.001"], {"category": "registry_set"}),
    Rule("Event Log Cleared", {"selection": {"EventID": [1102, 104]}, "condition": "selection"}, "critical", ["attack.defense_evasion", "attack.t1070.001"], {"service": "security"}),
    Rule("Scheduled Task Creation With Suspicious Command", {"selection": {"CommandName|contains": ["powershell", "cmd.exe", "wscript", "mshta", "rundll32", "-enc"]}, "condition": "selection"}, "medium", ["attack.persistence", "attack.t1053.005"], {"category": "scheduled_task"}),
    Rule("PsExec Service Execution", {"selection": {"CommandLine|contains": ["psexec", "paexec", "\\\\\\\\"]}, "selection_remote": {"CommandLine|contains": ["-u ", "accepteula"]}, "condition": "selection and selection_remote"}, "high", ["attack.lateral_movement", "attack.t1021.002"], _PROCESS),
)
