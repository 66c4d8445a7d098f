"""Word lists, patterns and lookup tables that results depend on.

Everything here is data, in its natural order. Patterns are searched without regard to case unless said otherwise."""

LOLBINS = (
    "powershell.exe",
    "pwsh.exe",
    "cmd.exe",
    "wscript.exe",
    "cscript.exe",
    "mshta.exe",
    "rundll32.exe",
    "regsvr32.exe",
    "certutil.exe",
    "bitsadmin.exe",
    "wmic.exe",
    "msbuild.exe",
    "installutil.exe",
    "regasm.exe",
    "regsvcs.exe",
    "msiexec.exe",
    "scriptrunner.exe",
    "forfiles.exe",
    "pcalua.exe",
    "syncappvpublishingserver.exe",
    "schtasks.exe",
    "at.exe",
    "sc.exe",
    "net.exe",
    "net1.exe",
    "reg.exe",
    "vssadmin.exe",
    "wevtutil.exe",
    "fsutil.exe",
    "cipher.exe",
    "takeown.exe",
    "psexec.exe",
    "psexesvc.exe",
    "wsmprovhost.exe",
    "winrs.exe",
)

COMMAND_SIGNATURES = (
    (r"-enc(?:odedcommand)?\s+[A-Za-z0-9+/]{20,}", "PowerShell encoded command", "high"),
    (r"-e\s+[A-Za-z0-9+/]{20,}", "PowerShell encoded command (short flag)", "high"),
    ("FromBase64String", "Base64 decoding in command", "high"),
    (r"-w(?:indowstyle)?\s+hidden", "Hidden window", "medium"),
    ("-nop|-noprofile", "PowerShell no-profile", "medium"),
    ("-noni|-noninteractive", "PowerShell non-interactive", "medium"),
    (r"\bIEX\b|Invoke-Expression", "PowerShell Invoke-Expression", "high"),
    ("DownloadString|DownloadFile|DownloadData", "Remote download", "high"),
    (r"Net\.WebClient|Invoke-WebRequest|\bwget\b|curl\s+http", "Web request in command", "medium"),
    (r"-ExecutionPolicy\s+(bypass|unrestricted)|\bbypass\b\s+-", "Execution policy bypass", "medium"),
    ("hidden.*FromBase64|FromBase64.*hidden", "Hidden + encoded", "critical"),
    ("certutil.*-decode|certutil.*-urlcache", "Certutil abuse", "high"),
    (r"bitsadmin.*\/transfer", "BITS transfer (download)", "high"),
    (r"regsvr32.*\/i:http|regsvr32.*scrobj", "Regsvr32 scriptlet (Squiblydoo)", "critical"),
    ("mshta.*http|mshta.*javascript|mshta.*vbscript", "MSHTA remote/script", "high"),
    (r"rundll32.*javascript|rundll32.*url\.dll", "Rundll32 abuse", "high"),
    ("vssadmin.*delete|wmic.*shadowcopy.*delete", "Shadow copy deletion", "critical"),
    ("wevtutil.*cl|wevtutil.*clear-log", "Event log clearing", "critical"),
    ("wbadmin.*delete", "Backup deletion", "critical"),
    ("bcdedit.*recoveryenabled.*no|bcdedit.*bootstatuspolicy", "Boot config tampering", "high"),
    (r"net\s+user\s+\/add|net\s+localgroup.*\/add", "Account/group manipulation", "high"),
    (r"schtasks.*\/create", "Scheduled task creation", "medium"),
    (r"reg\s+add.*\\Run|reg\s+add.*CurrentVersion\\Run", "Registry run key addition", "high"),
    (r"-ExecutionPolicy\s+Bypass.*-File.*\\(Temp|AppData|ProgramData)", "Script from suspicious path", "high"),
    (r"\\\\.*\\(C\$|ADMIN\$|IPC\$)", "Admin share access", "medium"),
    ("mimikatz|sekurlsa|lsadump|kerberos::|crypto::", "Mimikatz/credential dumping", "critical"),
    (r"comsvcs\.dll.*MiniDump|rundll32.*MiniDump", "LSASS memory dump (comsvcs)", "critical"),
    ("procdump.*lsass|procdump.*-ma", "ProcDump on LSASS", "critical"),
    (r"reg\s+save.*\\SAM|reg\s+save.*\\SYSTEM|reg\s+save.*\\SECURITY", "Registry hive dump (creds)", "critical"),
    (r"ntdsutil|ntds\.dit", "NTDS.dit extraction (domain creds)", "critical"),
    ("vaultcmd|vault::|CredentialManager", "Windows Credential Manager access", "high"),
    (r"\\User Data\\.*\\Login Data|\\User Data\\.*\\Cookies|\\User Data\\.*\\Web Data", "Browser credential/cookie store access", "high"),
    (r"\\Login Data\b|\\Cookies\b|\\Network\\Cookies", "Browser saved-password/cookie DB access", "high"),
    ("sqlite.*(Login Data|Cookies|Web Data)|(Login Data|Cookies).*sqlite", "Browser credential DB read via SQLite", "high"),
    (r"redline|raccoon|lumma|vidar|stealc|meta\s?stealer|aurora\s?stealer|mars\s?stealer|azorult|formbook|agent\s?tesla", "Known infostealer malware family", "critical"),
    (r"\\Local State\b.*encrypted_key|os_crypt|DPAPI.*Chrome|Chrome.*masterkey", "Browser master key (DPAPI) theft — cookie decryption", "critical"),
    (r"(token|cookie|credential)s?\.(txt|json|sqlite|db).*(upload|exfil|post)|grab.*(cookie|password|token)", "Credential/cookie exfiltration", "critical"),
    (r"\\Microsoft\\Edge\\User Data|\\BraveSoftware\\.*\\User Data|\\Mozilla\\Firefox\\Profiles.*\.(sqlite|db)", "Browser profile credential access", "high"),
    ("psexec|paexec|csexec", "PsExec lateral movement", "high"),
    (r"wmic.*\/node:|wmic.*process call create", "WMIC remote execution", "high"),
    ("Invoke-Command.*-ComputerName|Enter-PSSession", "PowerShell remoting", "medium"),
    ("sc\\s+\\\\\\\\|sc.exe\\s+\\\\\\\\", "Remote service creation", "high"),
    (r"at\s+\\\\|schtasks.*\/s\s+", "Remote scheduled task", "high"),
    ("wmiexec|smbexec|atexec|dcomexec", "Impacket lateral tool", "critical"),
    (r"anydesk|teamviewer|screenconnect|connectwise|splashtop|gotoassist|logmein|remotepc|ammyy|ultraviewer|atera|syncro|datto\s?rmm|kaseya|n-?able|pulseway|jwrapper.*remote|netlock.*rmm|action1|dwagent|dwservice|rustdesk|meshagent|mesh\s?central|tacticalrmm|_rmm_|\\rmm\\|rmm_agent|rmm_v\d", "Remote access / RMM tool present", "medium"),
    (r"Compress-Archive|makecab|7z\s+a|rar\s+a|winrar", "Archive creation (staging)", "medium"),
    (r"Invoke-WebRequest.*-Method\s+Put|curl.*-T\s|curl.*--upload", "Data upload", "high"),
    (r"ftp\s+-s:|Net\.WebClient.*UploadFile", "FTP/web upload", "high"),
    ("nslookup.*-type=txt|dns.*exfil", "Possible DNS exfiltration", "high"),
    (r"cipher\s+\/w|sdelete", "Secure deletion (anti-recovery)", "high"),
    (r"\.locked|\.encrypted|\.crypt|README.*DECRYPT|HOW.*DECRYPT", "Ransomware artifacts", "critical"),
    (r"taskkill.*\/f.*\/im.*(sql|oracle|exchange|backup)", "Killing business services (ransomware)", "high"),
    (r"wmic.*shadowcopy.*delete|vssadmin.*delete\s+shadows", "Shadow copy deletion (ransomware)", "critical"),
    ("Set-MpPreference.*-Disable|Add-MpPreference.*-Exclusion", "Windows Defender tampering", "high"),
    (r"netsh.*firewall.*disable|netsh advfirewall set.*state\s+off", "Firewall disabled", "high"),
    ("Set-ExecutionPolicy.*Unrestricted|Set-ExecutionPolicy.*Bypass", "Execution policy weakened", "medium"),
    (r"attrib.*\+h|attrib.*\+s", "Hiding files (attrib)", "low"),
    (r"timestomp|SetFileTime|\$STANDARD_INFORMATION", "Timestamp manipulation", "high"),
    ("fodhelper|computerdefaults|sdclt|eventvwr.*reg", "UAC bypass technique", "high"),
    (r"whoami\s+\/priv|whoami\s+\/groups", "Privilege enumeration", "low"),
    (r"net\s+group.*\/domain|net\s+user.*\/domain", "Domain enumeration", "medium"),
    ("nltest|dsquery|adfind", "AD reconnaissance", "medium"),
    ("Get-ADUser|Get-ADComputer|Get-DomainUser", "PowerView/AD enum", "medium"),
    (r"arp\s+-a|route\s+print|ipconfig\s+\/all", "Network discovery", "low"),
)

PATH_SIGNATURES = (
    ("\\\\Temp\\\\", "Running from Temp", "medium"),
    ("\\\\AppData\\\\Local\\\\Temp\\\\", "Running from user Temp", "medium"),
    ("\\\\AppData\\\\Roaming\\\\", "Running from Roaming AppData", "low"),
    ("\\\\ProgramData\\\\", "Running from ProgramData", "low"),
    ("\\\\Users\\\\Public\\\\", "Running from Public", "medium"),
    ("\\\\Downloads\\\\", "Running from Downloads", "medium"),
    ("\\\\Windows\\\\Temp\\\\", "Running from Windows Temp", "medium"),
    ("\\\\\\$Recycle\\.Bin\\\\", "Running from Recycle Bin", "high"),
    ("\\\\PerfLogs\\\\", "Running from PerfLogs", "medium"),
    (r"C:\\Windows\\[^\\]+\.exe", "Executable directly in Windows root", "medium"),
)

WINDOWS_ROOT_NAMES = ("explorer.exe", "notepad.exe", "regedit.exe", "write.exe", "hh.exe", "winhlp32.exe", "splwow64.exe", "bfsvc.exe", "twunk_16.exe", "twunk_32.exe", "ssvagent.exe")

SYSTEM_PROCESS_PATHS = {
    "svchost.exe": r"\\Windows\\System32\\svchost\.exe",
    "lsass.exe": r"\\Windows\\System32\\lsass\.exe",
    "services.exe": r"\\Windows\\System32\\services\.exe",
    "csrss.exe": r"\\Windows\\System32\\csrss\.exe",
    "winlogon.exe": r"\\Windows\\System32\\winlogon\.exe",
    "explorer.exe": r"\\Windows\\explorer\.exe",
    "smss.exe": r"\\Windows\\System32\\smss\.exe",
    "wininit.exe": r"\\Windows\\System32\\wininit\.exe",
    "spoolsv.exe": r"\\Windows\\System32\\spoolsv\.exe",
    "taskhostw.exe": r"\\Windows\\System32\\taskhostw\.exe",
}

KNOWN_GOOD_SERVICE_PATHS = (
    "\\windows\\system32\\",
    "\\windows\\syswow64\\",
    "\\windows\\microsoft.net\\",
    "\\windows\\servicing\\",
    "\\program files\\windows defender\\",
    "\\program files\\microsoft\\",
    "\\program files (x86)\\microsoft\\",
    "\\program files\\common files\\microsoft shared\\",
)

KNOWN_GOOD_SERVICE_NAMES = ("msiserver", "trustedinstaller", "wuauserv", "bits", "wsearch", "windefend", "wscsvc", "securityhealthservice", "sense", "diagtrack", "dps", "wdiservicehost")

WATCHED_PORTS = {
    4444: "Metasploit default",
    5555: "Common backdoor",
    1337: "Common backdoor",
    31337: "Back Orifice",
    6666: "Common IRC bot",
    6667: "IRC",
    8080: "Common HTTP proxy/C2",
    8443: "Alt HTTPS/C2",
    9001: "Tor",
    9050: "Tor SOCKS",
    1080: "SOCKS proxy",
    3389: "RDP (lateral movement)",
    5985: "WinRM HTTP",
    5986: "WinRM HTTPS",
}

DGA_EXEMPT_DOMAINS = (
    "amazonaws.com",
    "cloudfront.net",
    "akamai.net",
    "akamaiedge.net",
    "windowsupdate.com",
    "microsoft.com",
    "office.com",
    "office365.com",
    "googleusercontent.com",
    "googleapis.com",
    "gstatic.com",
    "cloudflare.com",
    "fastly.net",
    "azureedge.net",
    "azure.com",
    "doubleclick.net",
    "google-analytics.com",
)

SYSMON_PARENT_CHILDREN = {
    "winword.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe"],
    "excel.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe"],
    "outlook.exe": ["powershell.exe", "cmd.exe", "wscript.exe", "mshta.exe"],
    "powerpnt.exe": ["powershell.exe", "cmd.exe", "wscript.exe"],
    "w3wp.exe": ["cmd.exe", "powershell.exe", "net.exe", "whoami.exe"],
    "sqlservr.exe": ["cmd.exe", "powershell.exe"],
    "mshta.exe": ["powershell.exe", "cmd.exe", "rundll32.exe"],
    "wmiprvse.exe": ["cmd.exe", "powershell.exe", "wscript.exe"],
    "services.exe": ["cmd.exe", "powershell.exe"],
}

LSASS_READERS = ("wininit.exe", "services.exe", "lsass.exe", "csrss.exe", "winlogon.exe", "svchost.exe", "msmpeng.exe", "msascuil.exe", "nissrv.exe", "sentinelagent.exe", "csfalconservice.exe", "cb.exe", "cbcomms.exe")

AUTORUN_KEYS = (r"\run", r"\runonce", r"\runservices", r"\winlogon", r"\explorer\shell", r"\policies\explorer\run", r"\currentversion\run", "userinit", r"\image file execution", r"\appinit_dlls", r"\shellserviceobjectdelayload")

HASH_FIELDS = ("md5", "sha1", "sha256", "sha-256", "sha_256", "hash", "filehash", "file_hash", "imphash")

VENDOR_PATHS = (
    r"\program files\windows defender",
    "/program files/windows defender",
    "sentinelone",
    "sentinel agent",
    "sentinelui",
    "crowdstrike",
    "\\falcon\\",
    "/falcon/",
    "carbon black",
    "carbonblack",
    "\\cb\\",
    r"microsoft\windows defender",
    "microsoft/windows defender",
    r"\msmpeng",
    "windefend",
    "mcafee",
    "symantec",
    "sophos",
    "trend micro",
    "trendmicro",
    "eset\\",
    "eset/",
    "kaspersky",
    "bitdefender",
    "malwarebytes",
    "cylance",
    "cortex xdr",
    "\\sysinternals\\",
    "/sysinternals/",
    "\\program files\\git\\",
    "/program files/git/",
    "\\powershell\\",
    "/powershell/",
)

SPECIFIC_CONTENT_RULES = ("SUSP_Mimikatz_Strings", "SUSP_CobaltStrike_Beacon_Indicators", "SUSP_Ransomware_Note_Indicators")

MALWARE_FAMILIES = {
    "CAPE_Hijackloaderstub": ("critical", "T1574.002", "HijackLoader stub"),
    "CAPE_Hijackloader": ("critical", "T1574.002", "HijackLoader"),
    "HijackLoader": ("critical", "T1574.002", "HijackLoader"),
    "SUSP_CobaltStrike": ("critical", "T1071.001", "Cobalt Strike beacon"),
    "CobaltStrike": ("critical", "T1071.001", "Cobalt Strike"),
    "CAPE_CobaltStrike": ("critical", "T1071.001", "Cobalt Strike"),
    "Meterpreter": ("critical", "T1059.001", "Meterpreter"),
    "CAPE_Meterpreter": ("critical", "T1059.001", "Meterpreter"),
    "Sliver": ("critical", "T1071.001", "Sliver C2"),
    "Brute_Ratel": ("critical", "T1071.001", "Brute Ratel C4"),
    "CAPE_AsyncRAT": ("critical", "T1571", "AsyncRAT"),
    "CAPE_NjRat": ("critical", "T1571", "NjRAT"),
    "CAPE_Quasar": ("critical", "T1571", "QuasarRAT"),
    "SUSP_Mimikatz": ("critical", "T1003.001", "Mimikatz"),
    "Mimikatz": ("critical", "T1003.001", "Mimikatz"),
    "CAPE_Mimikatz": ("critical", "T1003.001", "Mimikatz"),
    "CAPE_LockBit": ("critical", "T1486", "LockBit ransomware"),
    "CAPE_Ryuk": ("critical", "T1486", "Ryuk ransomware"),
    "CAPE_Conti": ("critical", "T1486", "Conti ransomware"),
    "CAPE_BlackCat": ("critical", "T1486", "BlackCat/ALPHV ransomware"),
    "Ransomware": ("critical", "T1486", "Ransomware"),
    "COD3NYM_Reactor_Indicators": ("high", "T1027.002", "Ezriz .NET Reactor obfuscation"),
    "CAPE_DotNetReactor": ("high", "T1027.002", ".NET Reactor obfuscation"),
    "CAPE_ConfuserEx": ("high", "T1027.002", "ConfuserEx obfuscation"),
    "DITEKSHEN_INDICATOR_RMM": ("high", "T1219", "Remote monitoring/management tool"),
    "INDICATOR_RMM": ("high", "T1219", "Remote monitoring/management tool"),
    "Webshell": ("critical", "T1505.003", "Web shell"),
    "CAPE_Webshell": ("critical", "T1505.003", "Web shell"),
    "Rootkit": ("critical", "T1014", "Rootkit"),
    "Bootkit": ("critical", "T1542", "Bootkit"),
}

EXECUTION_PATHS = (
    ("\\\\Temp\\\\", "Executed from Temp", "medium"),
    ("\\\\AppData\\\\Local\\\\Temp\\\\", "Executed from user Temp", "medium"),
    ("\\\\AppData\\\\Roaming\\\\", "Executed from Roaming AppData", "low"),
    ("\\\\ProgramData\\\\", "Executed from ProgramData", "low"),
    ("\\\\Users\\\\Public\\\\", "Executed from Public", "medium"),
    ("\\\\Downloads\\\\", "Executed from Downloads", "medium"),
    ("\\\\Windows\\\\Temp\\\\", "Executed from Windows Temp", "medium"),
    ("\\\\\\$Recycle\\.Bin\\\\", "Executed from Recycle Bin", "high"),
    (r"^[A-Z]:\\[^\\]+\.exe$", "Executed directly from drive root", "medium"),
)

BROWSE_PATHS = (
    ("\\\\Temp\\\\", "Browsed to Temp folder", "low"),
    ("\\\\AppData\\\\", "Browsed to AppData", "low"),
    ("\\\\\\$Recycle\\.Bin\\\\", "Browsed to Recycle Bin", "medium"),
    (r"^[A-Z]:\\$", "Browsed to removable/external drive root", "medium"),
    (r"\\\\[^\\]+\\[^\\]+", "Browsed to network share (UNC path)", "medium"),
)

TRUSTED_ROOTS = ("c:\\\\windows\\\\system32\\\\", "c:\\\\windows\\\\syswow64\\\\", "c:\\\\windows\\\\winsxs\\\\", "c:\\\\program files\\\\windows defender\\\\", "c:\\\\program files\\\\common files\\\\microsoft shared\\\\")

APPDATA_APPS = (
    "\\\\local\\\\slack\\\\",
    "\\\\roaming\\\\telegram desktop\\\\",
    "\\\\roaming\\\\viberpc\\\\",
    "\\\\local\\\\discord\\\\",
    "\\\\local\\\\teams\\\\",
    "\\\\roaming\\\\zoom\\\\",
    "\\\\local\\\\zoom\\\\",
    "\\\\roaming\\\\skype\\\\",
    "\\\\local\\\\microsoft\\\\teams\\\\",
    "\\\\local\\\\microsoft\\\\onedrive\\\\",
    "\\\\local\\\\microsoft\\\\edge\\\\",
    "\\\\local\\\\microsoft\\\\edgewebview\\\\",
    r"\\local\\temp\\.*windowsdesktop-runtime",
    "\\\\local\\\\temp\\\\.*\\.be\\\\",
    "\\\\local\\\\temp\\\\.*\\.cr\\\\",
    "\\\\local\\\\google\\\\chrome\\\\",
    "\\\\local\\\\chromium\\\\",
    "\\\\roaming\\\\opera software\\\\",
    "\\\\local\\\\brave-browser\\\\",
    r"squirrel\.exe",
    r"update\.exe",
    "\\\\apps\\\\2\\.0\\\\",
)

SYSTEM_BINARIES = (
    "svchost.exe",
    "lsass.exe",
    "services.exe",
    "csrss.exe",
    "winlogon.exe",
    "wininit.exe",
    "smss.exe",
    "spoolsv.exe",
    "taskhostw.exe",
    "dwm.exe",
    "explorer.exe",
    "rundll32.exe",
    "conhost.exe",
    "fontdrvhost.exe",
    "sihost.exe",
    "ctfmon.exe",
    "searchindexer.exe",
    "runtimebroker.exe",
)

TIMESTAMP_FIELDS = ("TimeCreated", "timestamp", "Timestamp", "time", "Time", "CreateTime", "create_time", "creation_time", "CreationDate", "last_run", "LastRunTimes", "EventTime", "@timestamp", "Mtime", "modified", "last_execution")

BOOT_PROCESSES = ("registry", "system", "smss.exe", "csrss.exe", "wininit.exe", "winlogon.exe", "services.exe", "lsass.exe", "svchost.exe", "fontdrvhost.exe", "dwm.exe", "spoolsv.exe", "lsm.exe", "memory compression", "secure system", "idle")

BURST_PROCESSES = (
    "powershell.exe",
    "pwsh.exe",
    "cmd.exe",
    "wscript.exe",
    "cscript.exe",
    "mshta.exe",
    "rundll32.exe",
    "regsvr32.exe",
    "certutil.exe",
    "bitsadmin.exe",
    "psexec.exe",
    "psexesvc.exe",
    "mimikatz.exe",
    "procdump.exe",
    "wmic.exe",
    "net.exe",
    "net1.exe",
    "at.exe",
    "schtasks.exe",
    "reg.exe",
    "vssadmin.exe",
    "ntdsutil.exe",
    "rubeus.exe",
    "sharphound.exe",
    "cobaltstrike",
    "ncat.exe",
)

LINEAGES = (
    (["winword.exe", "excel.exe", "powerpnt.exe", "outlook.exe", "onenote.exe", "msaccess.exe", "mspub.exe", "visio.exe"], ["powershell.exe", "pwsh.exe", "cmd.exe", "wscript.exe", "cscript.exe", "mshta.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe", "bitsadmin.exe", "curl.exe"]),
    (["w3wp.exe", "httpd.exe", "nginx.exe", "tomcat.exe", "sqlservr.exe", "php-cgi.exe", "node.exe", "ManageEngine"], ["cmd.exe", "powershell.exe", "pwsh.exe", "net.exe", "net1.exe", "whoami.exe", "systeminfo.exe", "hostname.exe"]),
    (["mshta.exe", "wscript.exe", "cscript.exe", "hh.exe"], ["powershell.exe", "pwsh.exe", "cmd.exe", "rundll32.exe", "regsvr32.exe", "certutil.exe"]),
    (["regsvr32.exe", "msbuild.exe", "installutil.exe", "mavinject.exe", "odbcconf.exe"], ["cmd.exe", "powershell.exe", "pwsh.exe"]),
    (["services.exe"], ["cmd.exe", "powershell.exe", "pwsh.exe"]),
    (["powershell.exe", "pwsh.exe", "cmd.exe"], ["procdump.exe", "mimikatz.exe", "psexec.exe", "vssadmin.exe", "ntdsutil.exe", "rubeus.exe", "secretsdump"]),
    (["wmiprvse.exe"], ["cmd.exe", "powershell.exe", "pwsh.exe"]),
    (["taskeng.exe"], ["powershell.exe", "pwsh.exe", "wscript.exe", "cscript.exe", "mshta.exe"]),
)

TOOL_NAMES = ("mimikatz.exe", "psexec.exe", "psexesvc.exe", "procdump.exe", "wce.exe", "gsecdump.exe", "pwdump.exe", "lazagne.exe", "rubeus.exe", "sharphound.exe", "bloodhound.exe", "seatbelt.exe", "cobaltstrike", "beacon.exe", "meterpreter", "ncat.exe")

LOGSOURCE_ARTIFACTS = {
    "process_creation": ["pslist", "process", "pstree", "4688", "sysmon"],
    "network_connection": ["netstat", "network", "connection", "sysmon"],
    "registry_set": ["registry", "run", "autorun"],
    "registry_event": ["registry", "run", "autorun"],
    "registry_add": ["registry", "run", "autorun"],
    "file_event": ["file", "matches", "searchglobs", "upload", "lnk"],
    "image_load": ["sysmon", "dll"],
    "scheduled_task": ["task", "scheduledtask", "schtasks"],
    "service_creation": ["service", "7045", "executable"],
    "ps_script": ["powershell", "4104", "scriptblock"],
    "ps_module": ["powershell", "4103"],
    "security": ["eventlog", "security", "evtx"],
    "system": ["eventlog", "system", "evtx"],
}

FIELD_ALIASES = {
    "Image": ["Image", "Exe", "Path", "ExecutablePath", "NewProcessName", "path", "name", "Name"],
    "CommandLine": ["CommandLine", "cmdline", "Cmd", "ProcessCommandLine", "Arguments"],
    "ParentImage": ["ParentImage", "ParentProcessName", "parent_path"],
    "ParentCommandLine": ["ParentCommandLine", "parent_cmdline"],
    "TargetFilename": ["TargetFilename", "FullPath", "path", "Path", "OSPath", "FileName"],
    "Image|endswith": ["Image", "Exe", "Path", "name", "Name"],
    "DestinationPort": ["DestinationPort", "RemotePort", "remote_port", "Raddr"],
    "DestinationIp": ["DestinationIp", "RemoteAddress", "remote", "Raddr"],
    "SourceIp": ["SourceIp", "LocalAddress", "local", "Laddr"],
    "User": ["User", "Username", "user", "account", "SubjectUserName", "TargetUserName"],
    "ServiceName": ["ServiceName", "Name", "name"],
    "ServiceFileName": ["ServiceFileName", "PathName", "ImagePath", "image_path", "path", "ImagePath"],
    "TargetObject": ["TargetObject", "key", "Key", "FullPath"],
    "Details": ["Details", "value", "Value", "Data"],
    "EventID": ["EventID", "event_id", "Id", "ID", "EventId"],
    "Channel": ["Channel", "channel", "LogName", "log_name", "artifact"],
    "Provider": ["Provider", "Provider_Name", "ProviderName", "provider", "SourceName"],
    "ScriptBlockText": ["ScriptBlockText", "data", "Message", "message", "Path"],
    "TaskName": ["TaskName", "Name", "name"],
    "CommandName": ["Command", "command", "Action"],
    "ParentProcessName": ["ParentProcessName", "ParentImage", "parent_path"],
    "NewProcessName": ["NewProcessName", "Image", "Exe", "path"],
    "OriginalFileName": ["OriginalFileName", "original_filename"],
    "Hashes": ["Hashes", "Hash", "sha256", "SHA256", "md5", "MD5"],
    "IntegrityLevel": ["IntegrityLevel", "integrity_level"],
    "LogonType": ["LogonType", "logon_type"],
    "TargetImage": ["TargetImage", "target_image"],
    "SourceImage": ["SourceImage", "source_image"],
    "QueryName": ["QueryName", "query_name", "query"],
    "DestinationHostname": ["DestinationHostname", "dest_hostname", "remote"],
}

TECHNIQUE_TACTICS = {
    "T1059": "Execution",
    "T1204": "Execution",
    "T1106": "Execution",
    "T1053": "Persistence",
    "T1547": "Persistence",
    "T1543": "Persistence",
    "T1136": "Persistence",
    "T1546": "Persistence",
    "T1574": "Persistence",
    "T1505": "Persistence",
    "T1055": "Privilege Escalation",
    "T1548": "Privilege Escalation",
    "T1134": "Privilege Escalation",
    "T1036": "Defense Evasion",
    "T1070": "Defense Evasion",
    "T1562": "Defense Evasion",
    "T1112": "Defense Evasion",
    "T1027": "Defense Evasion",
    "T1218": "Defense Evasion",
    "T1140": "Defense Evasion",
    "T1003": "Credential Access",
    "T1110": "Credential Access",
    "T1555": "Credential Access",
    "T1552": "Credential Access",
    "T1558": "Credential Access",
    "T1087": "Discovery",
    "T1082": "Discovery",
    "T1057": "Discovery",
    "T1018": "Discovery",
    "T1083": "Discovery",
    "T1016": "Discovery",
    "T1033": "Discovery",
    "T1021": "Lateral Movement",
    "T1570": "Lateral Movement",
    "T1071": "Command and Control",
    "T1571": "Command and Control",
    "T1105": "Command and Control",
    "T1572": "Command and Control",
    "T1090": "Command and Control",
    "T1041": "Exfiltration",
    "T1048": "Exfiltration",
    "T1567": "Exfiltration",
    "T1486": "Impact",
    "T1490": "Impact",
    "T1489": "Impact",
    "T1485": "Impact",
    "T1566": "Initial Access",
    "T1190": "Initial Access",
    "T1078": "Initial Access",
    "T1560": "Collection",
    "T1005": "Collection",
    "T1114": "Collection",
}

TACTIC_ORDER = (
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
    "Other",
    "Uncategorized",
)

SAFE_ADDRESSES = ("127.0.0.1", "0.0.0.0", "::1", "255.255.255.255")

SYSTEM_ACCOUNTS = (
    "SYSTEM",
    "LOCAL SERVICE",
    "NETWORK SERVICE",
    "NT AUTHORITY",
    r"NT AUTHORITY\SYSTEM",
    r"NT AUTHORITY\LOCAL SERVICE",
    r"NT AUTHORITY\NETWORK SERVICE",
    "BUILTIN",
    "Everyone",
    "Authenticated Users",
    "INTERACTIVE",
    "SERVICE",
    "ANONYMOUS LOGON",
    "IUSR",
    "DefaultAccount",
    "Guest",
    "root",
    "nobody",
    "daemon",
    "www-data",
    "sshd",
)

SYSTEM_SIDS = (
    "S-1-0",
    "S-1-1",
    "S-1-2",
    "S-1-3",
    "S-1-5-1",
    "S-1-5-2",
    "S-1-5-3",
    "S-1-5-4",
    "S-1-5-6",
    "S-1-5-7",
    "S-1-5-8",
    "S-1-5-9",
    "S-1-5-10",
    "S-1-5-11",
    "S-1-5-12",
    "S-1-5-13",
    "S-1-5-14",
    "S-1-5-15",
    "S-1-5-17",
    "S-1-5-18",
    "S-1-5-19",
    "S-1-5-20",
    "S-1-5-32",
    "S-1-5-64",
    "S-1-5-80",
    "S-1-5-83",
    "S-1-5-90",
    "S-1-5-113",
    "S-1-5-114",
)

KNOWN_EXTERNAL_DOMAINS = (
    "microsoft.com",
    "windows.com",
    "windowsupdate.com",
    "google.com",
    "googleapis.com",
    "apple.com",
    "icloud.com",
    "amazon.com",
    "amazonaws.com",
    "cloudflare.com",
    "github.com",
    "githubusercontent.com",
    "ubuntu.com",
    "debian.org",
    "office.com",
    "outlook.com",
    "virustotal.com",
    "abuse.ch",
    "verisign.com",
    "digicert.com",
)

PII_PATTERNS = (
    ("ad_identity", r"(?<![A-Za-z\\])([A-Z][A-Z0-9_-]{1,15})\\([a-zA-Z][a-zA-Z0-9._-]{0,30})", 0),
    ("upn_identity", r"\b([a-zA-Z][a-zA-Z0-9._-]{0,30})@([a-zA-Z0-9-]+\.(?:local|internal|corp|lan|ad|intra|pri|domain)(?:\.[a-zA-Z]{2,})?)\b", 0),
    ("sid", r"\bS-1-5-21-\d{8,12}-\d{8,12}-\d{8,12}(?:-\d{1,10})?\b", 0),
    ("private_ip", r"\b10\.(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){2}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0),
    ("private_ip", r"\b172\.(?:1[6-9]|2\d|3[01])\.(?:\d{1,3}\.\d{1,3})\b", 0),
    ("private_ip", r"\b192\.168\.\d{1,3}\.\d{1,3}\b", 0),
    ("private_ip", r"\b169\.254\.\d{1,3}\.\d{1,3}\b", 0),
    ("public_ip", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b", 0),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", 0),
    ("private_ipv6", r"\bfd[0-9a-fA-F]{2}(?::[0-9a-fA-F]{1,4}){1,7}\b", 0),
    ("mac_address", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", 0),
    ("subnet", r"\b(?:10|172\.(?:1[6-9]|2\d|3[01])|192\.168)\.\d{1,3}\.\d{1,3}/\d{1,2}\b", 0),
    ("unc_path", r"\\\\[A-Za-z0-9._-]+(?:\\[A-Za-z0-9$._\\ -]+)+", 0),
    ("user_path_win", r"[Cc]:\\[Uu]sers\\([A-Za-z0-9._-]+)", 0),
    ("user_path_linux", "/home/([a-z_][a-z0-9_-]{0,30})", 0),
    ("registry_user", r"(?:HKEY_USERS|HKU)\\(?:S-1-5-21-[\d-]+|[A-Za-z0-9._-]+)", 0),
    ("ldap_dn", r"(?:CN|OU|DC)=[^,;\n]+(?:,\s*(?:CN|OU|DC)=[^,;\n]+){1,}", 1),
    ("gpo_guid", r"\{[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\}", 0),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", 0),
    ("internal_fqdn", r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9-]+)*\.(?:local|internal|corp|lan|ad|intra|pri|domain)\b", 1),
    ("external_fqdn", r"\b[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?(?:\.[a-zA-Z0-9-]+)*\.(?:com|org|net|io|gov|edu|co|info|biz|us|uk|de|fr|ru|cn|jp|au)\b", 1),
    ("computer_name", r"\b(?:DESKTOP|LAPTOP|SRV|SERVER|PC|WS|WORKSTATION|DC|VM|VDI|NB|HOST|NODE|WIN|APP|WEB|DB|FS|PS|TS|RDP|PRINT|EXCH|SQL|MAIL|DNS|DHCP|AD|CA|PKI|SCCM|WSUS|HV|ESX|NAS|SAN)[-_][A-Z0-9]{2,15}\b", 0),
    ("hostname", r"\b(?=[A-Z0-9-]{4,15}\b)(?=[A-Z0-9]*[A-Z])(?=[A-Z0-9]*[0-9])[A-Z][A-Z0-9-]{3,14}\b", 0),
)

SECURITY_SOFTWARE_PATHS = (
    "\\sentinelone\\",
    "/sentinelone/",
    "sentinel agent",
    "\\windows defender\\",
    "/windows defender/",
    r"\microsoft\windows defender",
    "/microsoft/windows defender",
    "\\crowdstrike\\",
    "/crowdstrike/",
    "\\carbon black\\",
    "/carbon black/",
    "\\carbonblack\\",
    "\\cylance\\",
    "/cylance/",
    "\\cortex xdr\\",
    "/cortex xdr/",
    "\\palo alto networks\\",
    "\\sophos\\",
    "/sophos/",
    "\\eset\\",
    "/eset/",
    "\\bitdefender\\",
    "/bitdefender/",
    "\\malwarebytes\\",
    "/malwarebytes/",
    "\\trend micro\\",
    "/trend micro/",
    "\\mcafee\\",
    "/mcafee/",
    "\\symantec\\",
    "/symantec/",
    "\\kaspersky\\",
    "/kaspersky/",
    "\\huntress\\",
    "/huntress/",
    "\\wazuh\\",
    "/wazuh/",
    "\\velociraptor\\",
    "/velociraptor/",
)

SCANNABLE_EXTENSIONS = (
    ".exe",
    ".dll",
    ".sys",
    ".scr",
    ".com",
    ".pif",
    ".cpl",
    ".ocx",
    ".ps1",
    ".psm1",
    ".vbs",
    ".vbe",
    ".js",
    ".jse",
    ".wsf",
    ".wsh",
    ".bat",
    ".cmd",
    ".hta",
    ".jar",
    ".msi",
    ".lnk",
    ".php",
    ".asp",
    ".aspx",
    ".jsp",
    ".jspx",
    ".dat",
    ".bin",
    ".tmp",
)
