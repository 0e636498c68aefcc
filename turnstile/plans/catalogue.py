"""The catalogue: services, the time format of their logs, and the patterns of failure lines, in order of trial."""

from __future__ import annotations

import re

# Service, time format, pattern. <HOST> stands for the address.
PATTERNS = r"""
sshd	syslog	sshd\[\d+\]: Failed password for .* from <HOST> port \d+
sshd	syslog	sshd\[\d+\]: Invalid user .* from <HOST> port \d+
sshd	syslog	sshd\[\d+\]: Connection closed by authenticating user .* <HOST> port \d+
sshd	syslog	sshd\[\d+\]: Disconnected from authenticating user .* <HOST> port \d+
nginx-auth	common	no user/password was provided for basic authentication.*client: <HOST>
nginx-auth	common	user .* was not found.*client: <HOST>
nginx-auth	common	user .* password mismatch.*client: <HOST>
nginx-botsearch	common	<HOST> .* "(GET|POST) /(wp-login|xmlrpc|wp-admin|\.env|phpmyadmin|admin)
postfix	syslog	postfix/smtpd\[\d+\]: warning: .*\[<HOST>\]: SASL .* authentication failed
postfix	syslog	postfix/smtpd\[\d+\]: NOQUEUE: reject: RCPT from .*\[<HOST>\]
dovecot	syslog	dovecot: .*auth failed.*rip=<HOST>
dovecot	syslog	dovecot: .*Aborted login.*rip=<HOST>
vsftpd	syslog	vsftpd.*FAIL LOGIN: Client "<HOST>"
asterisk	iso8601	NOTICE.* <HOST> failed to authenticate
asterisk	iso8601	SECURITY.* SecurityEvent="FailedACL".*RemoteAddress.*<HOST>
mysqld	iso8601	Access denied for user .*@'<HOST>'
mysqld	iso8601	Access denied for user .* from '<HOST>'
apache-auth	common	client <HOST>.*user .* authentication failure
apache-auth	common	client <HOST>.*user .* not found
apache-auth	common	client <HOST>.*password mismatch
apache-botsearch	common	client <HOST>.*File does not exist:.*/(wp-login|xmlrpc|\.env|phpmyadmin)
vaultwarden	iso8601	Username or password is incorrect.*IP: <HOST>
vaultwarden	iso8601	Invalid admin token.*IP: <HOST>
vaultwarden	iso8601	Invalid TOTP code.*IP: <HOST>
bitwarden	iso8601	Failed login attempt.* <HOST>
proxmox	syslog	pvedaemon\[.*authentication failure; rhost=<HOST>
gitlab	iso8601	Failed Login:.*ip=<HOST>
grafana	iso8601	Invalid username or password.*remote_addr=<HOST>
grafana	iso8601	User not found.*remote_addr=<HOST>
haproxy	syslog	haproxy\[\d+\]: <HOST>:\d+ .*\b401\b
drupal	syslog	drupal.*Login attempt failed from <HOST>
drupal	syslog	(?:[^|]*\|){3}<HOST>\|.*Login attempt failed
traefik	common	<HOST> .*" 401 
openvpn	syslog	ovpn-.* <HOST>:\d+ TLS Auth Error
openvpn	syslog	ovpn-.* <HOST>:\d+.*AUTH_FAILED
nginx-limit-req	common	limiting requests, excess: .* by zone .*, client: <HOST>,
nginx-limit-req	common	limiting connections by zone .*, client: <HOST>,
nginx-limit-req	common	delaying request.* by zone .*, client: <HOST>,
nginx-forbidden	common	access forbidden by rule, client: <HOST>,
nginx-bad-request	common	<HOST> - \S+ .+"[^"]*" 400 
proftpd	syslog	proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Login failed
proftpd	syslog	proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*no such user
proftpd	syslog	proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Incorrect password
proftpd	syslog	proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*SECURITY VIOLATION
proftpd	syslog	proftpd\[\d+\].*?\([^\[]+\[<HOST>\]\).*Maximum login attempts
pure-ftpd	syslog	pure-ftpd: \(.+?@<HOST>\) \[WARNING\]
courier-auth	syslog	LOGIN FAILED,.* ip=\[<HOST>\]
roundcube-auth	iso8601	(?i)login failed for .* from <HOST>
roundcube-auth	iso8601	(?i)failed login for .* from <HOST>
pam-generic	syslog	pam_unix.*authentication failure;.* rhost=<HOST>
apache-modsecurity	common	client <HOST>.*ModSecurity:.*Access denied with code [45]\d\d
dropbear	syslog	dropbear\[\d+\].*[Bb]ad password attempt for .* from <HOST>:\d+
dropbear	syslog	dropbear\[\d+\].*[Ll]ogin attempt for nonexistent user.*from <HOST>:\d+
dropbear	syslog	dropbear\[\d+\].*[Ee]xit before auth.*from .?<HOST>:\d+
netfilter-portscan	syslog	kernel: .*IN=\S+ .*SRC=<HOST> DST=\S+ .*PROTO=
pf-portscan	syslog	block in on \S+:\s+<HOST>\.\d+ >
pf-portscan	syslog	block in on \S+:\s+<HOST> >
pfsense-portscan	syslog	filterlog\[\d+\]: .*,block,in,4,(?:[^,]*,){9}<HOST>,
pfsense-portscan	syslog	filterlog\[\d+\]: .*,block,in,6,(?:[^,]*,){6}<HOST>,
named-refused	syslog	named\[\d+\].*client <HOST>#\d+.*(?:denied|REFUSED)
lighttpd-auth	iso8601	(?:password doesn.t match|digest: auth failed|get_password failed).* IP: <HOST>
phpmyadmin-syslog	syslog	phpMyAdmin\[\d+\]: user denied: .* from <HOST>
webmin-auth	syslog	webmin\[\d+\]: (?:Invalid|Non-existent) login as .* from <HOST>
squid	epoch	\d\s+<HOST>\s+[A-Z_]+_DENIED/\d+
squid	epoch	\d\s+<HOST>\s+NONE/405
freeswitch	iso8601	SIP auth (?:failure|challenge).* from ip <HOST>
freeswitch	iso8601	Can.t find user .* from <HOST>
softethervpn	iso8601	User authentication failed.* from <HOST>
guacamole	iso8601	Authentication attempt from <HOST> for user .* failed
mssql-auth	iso8601	Login failed for user .*\[CLIENT: <HOST>\]
sogo-auth	syslog	SOGoRootPage Login from '<HOST>.*might not have worked
horde	syslog	HORDE.*FAILED LOGIN for \S+ \[<HOST>\]
courier-smtp	syslog	courieresmtpd.*error,relay=<HOST>,
cyrus-imap	syslog	badlogin:.*\[<HOST>\].*SASL\(-13\)
routeros-auth	syslog	system,error,critical login failure for user .* from <HOST> via
znc-adminlog	iso8601	failed to login from <HOST>
screensharingd	syslog	screensharingd\[\d+\]: Authentication: FAILED.*Viewer Address: <HOST>
directadmin	iso8601	'<HOST>' \d+ failed login attempt
squirrelmail	common	from <HOST>: Unknown user or password incorrect
monit	syslog	Client .?<HOST>.? supplied wrong password
monit	syslog	Client .?<HOST>.? supplied unknown user
openhab	common	<HOST>\s+-\s+.+\s+"[A-Z]+ .+" 401 
nsd	epoch	nsd\[\d+\]: info: ratelimit block .* query <HOST>
nsd	epoch	nsd\[\d+\]:.*from client <HOST> refused
wuftpd	syslog	wu-ftpd\[\d+\]: failed login from .* \[<HOST>\]
portsentry	epoch	/<HOST> Port: \d+ (?:TCP|UDP) Blocked
kerio	common	SMTP Spam attack detected from <HOST>,
kerio	common	IP address <HOST>
xrdp	iso8601	AUTHFAIL: user=\S+ ip=<HOST>
apache-nohome	common	client <HOST>.*File does not exist:.*~
apache-noscript	common	client <HOST>.*script .* not found or unable to stat
apache-noscript	common	client <HOST>.*File does not exist:.*\.php
apache-overflows	common	client <HOST>.*(?:Invalid (?:method|URI)|request failed:)
apache-shellshock	common	client <HOST>.*AH01215:.*(?:bash|sh):.*HTTP_
sendmail-auth	syslog	\[<HOST>\]: possible SMTP attack: command=AUTH
exim	iso8601	authenticator failed for.*\[<HOST>\].*535 Incorrect authentication
centreon	iso8601	\[<HOST>\] Authentication failed
counter-strike	common	Bad Rcon:.*from "<HOST>:\d+"
domino-smtp	common	connecting host <HOST>
domino-smtp	common	smtp.*\[<HOST>\] authentication failure
froxlor-auth	syslog	Login Action <HOST>.*(?:Unknown user|wrong password)
groupoffice	iso8601	LOGIN FAILED.*IP: <HOST>
gssftpd	syslog	ftpd\[\d+\]: repeated login failures from <HOST>
murmur	iso8601	Rejected connection from <HOST>:\d+: (?:Invalid server password|Wrong certificate)
nagios	syslog	Host <HOST> is not allowed to talk to us
openwebmail	common	\(<HOST>\).*(?:login error|userinfo error)
php-url-fopen	common	<HOST> .*"(?:GET|POST).*\?.*=http://
qmail	syslog	rblsmtpd: <HOST>
qmail	syslog	badiprbl: ip <HOST>
scanlogd	syslog	scanlogd: <HOST> to
selinux-ssh	epoch	addr=<HOST>.*terminal=ssh.*res=failed
sieve	syslog	badlogin:.*\[<HOST>\].*authentication failure
solid-pop3d	syslog	solid-pop3d\[\d+\]: authentication failed:.* - <HOST>
suhosin	common	attacker '<HOST>'
tine20	iso8601	Login with username .* from <HOST> failed
uwimap-auth	syslog	Login failed user=.* \[<HOST>\]
xinetd-fail	syslog	FAIL:.*from=<HOST>
3proxy	common	PROXY\.\d+ \d{3}0[1-9] \S+ <HOST>:\d+
monitorix	common	NOTEXIST - \[<HOST>\]
monitorix	common	AUTHERR - \[<HOST>\]
monitorix	common	NOTALLOWED - \[<HOST>\]
zoneminder	common	client <HOST>.*Login denied for user
zoneminder	common	client <HOST>.*Could not retrieve user .* details
perdition	syslog	perdition.*Auth: <HOST>:\d+.*status=.failed
perdition	syslog	perdition.*Fatal Error reading authentication.*client <HOST>:\d+
stunnel	iso8601	SSL_accept from <HOST>:\d+ :.*SSL routines.*peer did not return a certificate
oracleims	iso8601	\|<HOST>\|\d+".*mi="Bad password"
"""

#: One address, as a group: a dotted quad, also mapped to version 6, or hex digits and colons.
HOST = r"((?:::[fF]{4}:)?\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}|[0-9a-fA-F:]{2,39})"
TAG = "<HOST>"
META = set("\\.*+?()[]{}|^$")


def catalogue() -> list[tuple[str, str, tuple[str, ...]]]:
    """(service, time format, patterns), in order."""
    found: dict[str, tuple[str, list[str]]] = {}
    for row in PATTERNS.strip("\n").split("\n"):
        service, form, pattern = row.split("\t")
        found.setdefault(service, (form, []))[1].append(pattern)
    return [(s, f, tuple(p)) for s, (f, p) in found.items()]


def patterns_of(service: str) -> tuple[str, ...]:
    return next(p for s, _, p in catalogue() if s == service)


def expand(pattern: str) -> str:
    """The pattern with its one <HOST> as a group; named groups as Java writes them."""
    if pattern.count(TAG) != 1:
        raise ValueError(f"a pattern needs one {TAG}: {pattern}")
    return pattern.replace("(?P<", "(?<").replace(TAG, HOST)


def host_group(pattern: str) -> int:
    """The number of <HOST>'s group: capturing groups before it, and one."""
    before, n, i, inside = pattern[: pattern.index(TAG)], 1, 0, False
    while i < len(before):
        c = before[i]
        if c == "\\":
            i += 1
        elif c == "[":
            inside = True
        elif c == "]":
            inside = False
        elif c == "(" and not inside and (before[i + 1 : i + 2] != "?" or before[i + 1 : i + 4] == "?P<" or before[i + 1 : i + 3] == "?<" and before[i + 3 : i + 4] not in ("=", "!")):
            n += 1
        i += 1
    return n


def literal_runs(part: str) -> list[str]:
    """Runs of characters without a special meaning."""
    runs, run = [], ""
    for c in part:
        if c in META:
            runs.append(run)
            run = ""
        else:
            run += c
    return [*runs, run]


def gate(pattern: str) -> str | None:
    """Text that a line must have before the pattern is tried.

    The run that ends at <HOST> if it has three characters; else the longest run before it that has; else a shorter run
    at <HOST>; else none.
    """
    # What names a group or begins a look around is no text of the line.
    runs = literal_runs(re.sub(r"\(\?(?:P?<\w+>|<?[=!])", "(", pattern[: pattern.index(TAG)]))
    if len(runs[-1]) >= 3:
        return runs[-1]
    longest = max(runs, key=len)
    return longest if len(longest) >= 3 else runs[-1] or None


def _atoms(pattern: str) -> list[tuple[str, str]]:
    """The pattern's parts in a row: (text, quantifier). A group, a class, <HOST>, an escape or a character is one text."""
    out, i = [], 0
    while i < len(pattern):
        start = i
        if pattern.startswith(TAG, i):
            i += len(TAG)
        elif pattern[i] == "\\":
            i += 2
        elif pattern[i] == "[":
            i += 2
            while pattern[i] != "]":
                i += 2 if pattern[i] == "\\" else 1
            i += 1
        elif pattern[i] == "(":
            depth = 0
            while True:
                c = pattern[i]
                if c == "[":
                    while pattern[i] != "]":
                        i += 2 if pattern[i] == "\\" else 1
                depth += (c == "(") - (c == ")")
                i += 2 if c == "\\" else 1
                if not depth:
                    break
        else:
            i += 1
        text, at = pattern[start:i], i
        if i < len(pattern) and pattern[i] in "*+?":
            i += 1
        elif i < len(pattern) and pattern[i] == "{":
            i = pattern.index("}", i) + 1
        if i > at and i < len(pattern) and pattern[i] in "?+":
            i += 1
        out.append((text, pattern[at:i]))
    return out


def literals(pattern: str) -> list[str]:
    """Texts of three characters or more that every matching line has, on both sides of <HOST>."""
    atoms = _atoms(pattern)
    if any(t.startswith("(?") and t[2:3] not in (":", "P", "<", "=", "!", ">") or t == "|" for t, _ in atoms):
        return []
    runs, run = [], ""
    for text, times in atoms:
        char = text if len(text) == 1 and text not in ".^$" else text[1] if len(text) == 2 and text[0] == "\\" and not text[1].isalnum() else None
        if char is None or times and times[0] in "*?{":
            runs.append(run)
            run = ""
            continue
        run += char
        if times:
            runs.append(run)
            run = ""
    return sorted({r for r in [*runs, run] if len(r) >= 3}, key=lambda r: (-len(r), r))


def needed(pattern: str) -> list[str]:
    """Texts without which a line is not tried: the gate first, which counts as it is written whatever the pattern's flags, then literals."""
    first = gate(pattern)
    rest = [x for x in literals(pattern) if x != first]
    held = [*([first] if first else []), *rest]
    return [x for x in held if not any(x != y and x in y for y in held)]


def rare_word(pattern: str) -> str | None:
    """The longest word that stands whole within a needed text: with other characters on both sides of it there."""
    inner = [w for x in needed(pattern) for w in re.findall(r"(?<=[^A-Za-z0-9])[A-Za-z0-9]+(?=[^A-Za-z0-9])", x)]
    return max(sorted(inner), key=len, default=None)


def _plain(text: str, times: str) -> bool:
    """Whether a part may stand in an atomic group: a character, a class, or alternatives of plain text."""
    if text.startswith("("):
        return not set("*+{.[") & set(re.sub(r"\\.", "", text)) and (text[1] != "?" or text.startswith("(?:"))
    return text not in ("|", "^", "$") and not re.fullmatch(r"\\[BAzZGk0-9]", text) and (text, times) != (".", "{")


def steady(pattern: str) -> str:
    """An equal form of expand(pattern) that gives up soon on lines made to match nearly.

    Where ``.*`` stands between parts, only one choice matters: each part ahead of <HOST>'s is as good at its first place as at any
    other, and of the parts behind it only their being there counts. So those are atomic; the gap ahead of <HOST>'s part stays as it
    is. A pattern with anything beyond plain parts is left alone.
    """
    atoms = _atoms(pattern)
    flags = ""
    if atoms and atoms[0][0].startswith("(?") and atoms[0][0].strip("(?)").isalpha():
        flags, atoms = atoms[0][0], atoms[1:]
    # Some n fields and then more of the pattern: as a match may begin anywhere, that is n fields or more from the start.
    fields, lead = re.fullmatch(r"\(\?:\[\^(\\?.)\]\*\\?(.)\)", atoms[0][0]), ""
    if fields and fields[1][-1] == fields[2] and re.fullmatch(r"\{\d+\}", atoms[0][1]):
        lead = f"^{atoms[0][0].replace('*', '*+', 1)}{atoms[0][1][:-1]},}}?"
        atoms = atoms[1:]
    pieces: list[list[tuple[str, str]]] = [[]]
    gaps = []
    for text, times in atoms:
        if text == "." and times[:1] in ("*", "+") and times:
            gaps.append(times)
            pieces.append([])
        else:
            pieces[-1].append((text, times))
    at = next(i for i, x in enumerate(pieces) if any(t == TAG for t, _ in x))
    atomic = [x for i, x in enumerate(pieces) if i != at]
    # A part that ends in a repeated character could take what the next one begins with.
    open_ended = [x for i, x in enumerate(pieces[:-1]) if i != at and (not x or x[-1][1])]
    if open_ended or not all(_plain(t, q) for x in pieces for t, q in x) or not atomic or lead and at:
        return expand(pattern)
    text = ["".join(t + q for t, q in x) for x in pieces]
    first = lambda gap, x: f"(?>.{gap[0]}?{x})"
    ahead = "".join(first(g, x) for g, x in zip(["*", *gaps], text[:at]))
    behind = "".join(first(g, x) for g, x in zip(gaps[at:], text[at + 1 :]))
    return flags + (f"^{ahead}.{gaps[at - 1]}" if at else lead) + text[at].replace(TAG, HOST) + behind
