"""A failure line for each service, written for this library; {ip} is the client's address."""

from __future__ import annotations

SAMPLES = r"""
sshd	Mar  4 10:11:12 box sshd[811]: Failed password for invalid user kim from {ip} port 4022 ssh2
nginx-auth	2024/03/04 10:11:12 [error] 7#7: *3 user "kim": password mismatch, client: {ip}, server: box
nginx-botsearch	{ip} - - [04/Mar/2024:10:11:12 +0000] "GET /wp-login.php HTTP/1.1" 404 12
postfix	Mar  4 10:11:12 box postfix/smtpd[41]: warning: unknown[{ip}]: SASL LOGIN authentication failed: no
dovecot	Mar  4 10:11:12 box dovecot: imap-login: Aborted login (auth failed, 1 attempts): user=<kim>, rip={ip}, lip=10.0.0.1
vsftpd	Mon Mar  4 10:11:12 2024 [pid 5] [kim] vsftpd FAIL LOGIN: Client "{ip}"
asterisk	[2024-03-04 10:11:12] NOTICE[9] chan_sip.c: Host {ip} failed to authenticate as 'kim'
mysqld	2024-03-04T10:11:12Z 5 [Note] Access denied for user 'kim'@'{ip}' (using password: YES)
apache-auth	[Mon Mar 04 10:11:12 2024] [auth_basic:error] [client {ip}:5] user kim: authentication failure for "/x": mismatch
apache-botsearch	[Mon Mar 04 10:11:12 2024] [error] [client {ip}] File does not exist: /srv/www/phpmyadmin
vaultwarden	[2024-03-04 10:11:12][identity][ERROR] Username or password is incorrect. Try again. IP: {ip}. Username: kim
bitwarden	2024-03-04 10:11:12 [Warning] Failed login attempt. {ip}
proxmox	Mar  4 10:11:12 box pvedaemon[77]: authentication failure; rhost={ip} user=kim@pam msg=no
gitlab	2024-03-04T10:11:12Z: Failed Login: username=kim ip={ip}
grafana	t=2024-03-04T10:11:12Z lvl=eror msg="Invalid username or password" remote_addr={ip}
haproxy	Mar  4 10:11:12 box haproxy[31]: {ip}:5012 [04/Mar/2024] web web/s1 0/0/1/2/3 401 212
drupal	Mar  4 10:11:12 box drupal: Login attempt failed from {ip} for kim
traefik	{ip} - kim [04/Mar/2024:10:11:12 +0000] "GET /admin HTTP/2.0" 401 17
openvpn	Mar  4 10:11:12 box ovpn-server[6]: {ip}:1194 TLS Auth Error: bad name
nginx-limit-req	2024/03/04 10:11:12 [error] 7#7: *3 limiting requests, excess: 5.1 by zone "z", client: {ip}, server: box
nginx-forbidden	2024/03/04 10:11:12 [error] 7#7: *3 access forbidden by rule, client: {ip}, server: box
nginx-bad-request	{ip} - - [04/Mar/2024:10:11:12 +0000] "x" 400 150
proftpd	Mar  4 10:11:12 box proftpd[12] box (far.example[{ip}]): USER kim: no such user found
pure-ftpd	Mar  4 10:11:12 box pure-ftpd: (?@{ip}) [WARNING] Authentication failed for user [kim]
courier-auth	Mar  4 10:11:12 box imapd: LOGIN FAILED, user=kim, ip=[{ip}]
roundcube-auth	[2024-03-04 10:11:12 +0000]: Login failed for kim from {ip} in session 7
pam-generic	Mar  4 10:11:12 box su: pam_unix(su:auth): authentication failure; logname= uid=0 tty=x rhost={ip} user=kim
apache-modsecurity	[04/Mar/2024:10:11:12 +0000] [error] [client {ip}] ModSecurity: Warning. Access denied with code 403 (phase 2)
dropbear	Mar  4 10:11:12 box dropbear[55]: bad password attempt for 'kim' from {ip}:6021
netfilter-portscan	Mar  4 10:11:12 box kernel: DROP IN=eth0 OUT= SRC={ip} DST=10.0.0.1 LEN=40 PROTO=TCP
pf-portscan	Mar  4 10:11:12 box pf: rule 3/0(match): block in on em0: {ip}.5021 > 10.0.0.1.22: S
pfsense-portscan	Mar  4 10:11:12 box filterlog[9]: 5,,,1000,em0,match,block,in,4,0x0,,64,1,0,none,6,tcp,60,{ip},10.0.0.1,5012,22
named-refused	Mar  4 10:11:12 box named[8]: client {ip}#5301 (example.org): query (cache) denied
lighttpd-auth	2024-03-04 10:11:12: (http_auth.c.1) password doesn't match for /x username: kim, IP: {ip}
phpmyadmin-syslog	Mar  4 10:11:12 box phpMyAdmin[71]: user denied: kim (mysql-denied) from {ip}
webmin-auth	Mar  4 10:11:12 box webmin[63]: Invalid login as kim from {ip}
squid	1709547072.123      4 {ip} TCP_DENIED/403 3900 GET http://example.org/ - HIER_NONE/- text/html
freeswitch	2024-03-04 10:11:12 [WARNING] SIP auth failure (REGISTER) on profile 'x' for [kim@box] from ip {ip}
softethervpn	2024-03-04 10:11:12 User authentication failed for kim, from {ip}
guacamole	2024-03-04 10:11:12 WARN - Authentication attempt from {ip} for user "kim" failed.
mssql-auth	2024-03-04 10:11:12 Logon Login failed for user 'kim'. Reason: none. [CLIENT: {ip}]
sogo-auth	Mar  4 10:11:12 box sogod[4]: SOGoRootPage Login from '{ip}' for user 'kim' might not have worked
horde	Mar  4 10:11:12 box HORDE: [imp] FAILED LOGIN for kim [{ip}] to box:143
courier-smtp	Mar  4 10:11:12 box courieresmtpd: error,relay={ip},from=<kim>: 535 no
cyrus-imap	Mar  4 10:11:12 box imaps[5]: badlogin: far [{ip}] PLAIN [SASL(-13): authentication failure: no] SASL(-13)
routeros-auth	Mar  4 10:11:12 box system,error,critical login failure for user kim from {ip} via ssh
znc-adminlog	[2024-03-04 10:11:12] [kim] failed to login from {ip}
screensharingd	Mar  4 10:11:12 box screensharingd[3]: Authentication: FAILED :: User Name: kim :: Viewer Address: {ip} :: Type: DH
directadmin	2024:03:04-10:11:12: '{ip}' 3 failed login attempts. Account 'kim'
squirrelmail	04/Mar/2024 10:11:12 [LOGIN_ERROR] kim (box) from {ip}: Unknown user or password incorrect.
monit	Mar  4 10:11:12 box monit[2]: Client '{ip}' supplied wrong password for user 'kim'
openhab	{ip}  -  kim [04/Mar/2024:10:11:12 +0000] "GET /rest HTTP/1.1" 401 1382
nsd	[1709547072] nsd[5]: info: ratelimit block example.org. type any target {ip} query {ip} ANY
wuftpd	Mar  4 10:11:12 box wu-ftpd[4]: failed login from far [{ip}]
portsentry	1709547072 - 03/04/2024 10:11:12 Host: far/{ip} Port: 23 TCP Blocked
kerio	[04/Mar/2024 10:11:12] SMTP Spam attack detected from {ip}, client closed
xrdp	[2024-03-04T10:11:12] [INFO ] AUTHFAIL: user=kim ip={ip} time=1
apache-nohome	[04/Mar/2024:10:11:12 +0000] [error] [client {ip}] File does not exist: /srv/~kim
apache-noscript	[04/Mar/2024:10:11:12 +0000] [error] [client {ip}] script '/srv/a.cgi' not found or unable to stat
apache-overflows	[04/Mar/2024:10:11:12 +0000] [error] [client {ip}] Invalid URI in request GET x
apache-shellshock	[04/Mar/2024:10:11:12 +0000] [error] [client {ip}] AH01215: /bin/bash: warning: HTTP_COOKIE: x
sendmail-auth	Mar  4 10:11:12 box sendmail[8]: far.example [{ip}]: possible SMTP attack: command=AUTH, count=5
exim	2024-03-04 10:11:12 plain authenticator failed for (kim) [{ip}]: 535 Incorrect authentication data
centreon	2024-03-04 10:11:12|-1|0|0|[web] [{ip}] Authentication failed for 'kim'
counter-strike	L 03/04/2024 - 10:11:12: Bad Rcon: "rcon 1 "x" status" from "{ip}:27005"
domino-smtp	04/Mar/2024:10:11:12 smtp: kim [{ip}] authentication failure using internet password
froxlor-auth	Mar  4 10:11:12 box froxlor: Login Action {ip} Unknown user 'kim'
groupoffice	[2024-03-04 10:11:12]LOGIN FAILED for user: kim from IP: {ip}
gssftpd	Mar  4 10:11:12 box ftpd[91]: repeated login failures from {ip} (far)
murmur	<W>2024-03-04 10:11:12.1 1 => <5:(-1)> Rejected connection from {ip}:5012: Invalid server password
nagios	Mar  4 10:11:12 box nrpe[1]: Host {ip} is not allowed to talk to us!
openwebmail	Mon Mar  4 10:11:12 2024 - [4] ({ip}) kim - login error - no such user
php-url-fopen	{ip} - - [04/Mar/2024:10:11:12 +0000] "GET /a.php?n=http://far.example/x HTTP/1.1" 200 4
qmail	Mar  4 10:11:12 box smtp: rblsmtpd: {ip} pid 5: 451 listed
scanlogd	Mar  4 10:11:12 box scanlogd: {ip} to 10.0.0.1 ports 80, 81, TOS 00
selinux-ssh	type=USER_LOGIN msg=audit(1709547072.1:5): acct="kim" hostname=? addr={ip} terminal=ssh res=failed
sieve	Mar  4 10:11:12 box sieve[7]: badlogin: far[{ip}] PLAIN authentication failure
solid-pop3d	Mar  4 10:11:12 box solid-pop3d[3]: authentication failed: no such user: kim - {ip}
suhosin	Mar/04/2024 suhosin[5]: ALERT - configured limit exceeded (attacker '{ip}', file '/a.php')
tine20	2024-03-04T10:11:12+00:00 WARN (4): Login with username kim from {ip} failed (-1)!
uwimap-auth	Mar  4 10:11:12 box imapd[4]: Login failed user=kim auth=kim host=far [{ip}]
xinetd-fail	Mar  4 10:11:12 box xinetd[4]: FAIL: ftp address from={ip}
3proxy	[04/Mar/2024 10:11:12] PROXY.3128 00004 kim {ip}:4012 0.0.0.0:0 0 0 0 GET
monitorix	Mon Mar  4 10:11:12 2024 - NOTEXIST - [{ip}] File does not exist: /x
zoneminder	[04/Mar/2024:10:11:12] [error] [client {ip}] WAR [Login denied for user "kim"]
perdition	Mar  4 10:11:12 box perdition[5]: Auth: {ip}:4012->10.0.0.1:143 user="kim" status="failed: no"
stunnel	2024.03.04 10:11:12 LOG3[5]: SSL_accept from {ip}:5012 : 1408F: SSL routines: peer did not return a certificate
oracleims	<co ts="2024-03-04T10:11:12" tr="|10.0.0.1|25|{ip}|4012" mi="Bad password" us="kim"/>
"""


def samples() -> list[tuple[str, str]]:
    return [tuple(row.split("\t", 1)) for row in SAMPLES.strip("\n").split("\n")]
