"""Labelled lines to train the credential tagger on, made at random from a grammar.

Every line comes with a label per character: k on the name of a credential, p on what
joins name and value, s on the secret itself, o elsewhere. No credential is stored; all
values are drawn from a seeded generator.
"""

from __future__ import annotations

import base64
import random
import string

LOW, UP, DIG = string.ascii_lowercase, string.ascii_uppercase, string.digits
ALNUM, HEX, URLSAFE, B64 = LOW + UP + DIG, DIG + "abcdef", LOW + UP + DIG + "-_", LOW + UP + DIG + "+/"

# Vendor formats as prefix, alphabet, least and greatest length.
VENDORS = [
    *[(p, ALNUM, 30, 40) for p in ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_", "hf_", "dckr_pat_", "dop_v1_", "shpat_", "r8_")],
    ("github_pat_", ALNUM + "_", 22, 82), ("glpat-", URLSAFE, 14, 24), ("sk-ant-", URLSAFE, 24, 60), ("sk-proj-", ALNUM, 30, 60),
    ("sk-", ALNUM, 30, 50), ("sk_live_", ALNUM, 16, 32), ("rk_live_", ALNUM, 16, 32), ("AKIA", UP + DIG, 16, 16), ("ASIA", UP + DIG, 16, 16),
    ("AIza", URLSAFE, 30, 36), ("xoxb-", DIG, 10, 13), ("xoxp-", DIG, 10, 13), ("xoxa-", DIG, 10, 13), ("xoxs-", DIG, 10, 13), ("xoxr-", DIG, 10, 13),
    ("pypi-", URLSAFE, 40, 60), ("ya29.", URLSAFE, 40, 60), ("SG.", URLSAFE, 20, 24), ("eyJ", URLSAFE, 20, 60), ("whsec_", ALNUM, 24, 36),
]
TEST_VENDORS = ("sk_test_", "pk_test_", "rk_test_", "whsec_test_")
SECRET_WORDS = [
    "password", "passwd", "pass", "pwd", "pw", "passphrase", "passwort", "kennwort", "contrasena", "mot_de_passe", "senha", "wachtwoord", "secret", "token",
    "api_key", "apikey", "access_token", "auth_token", "client_secret", "signing_secret", "webhook_secret", "deploy_key", "private_key", "service_token",
    "secret_key", "access_key", "encryption_key", "credential", "credentials", "bearer_token", "refresh_token", "session_secret", "jwt_secret", "auth_key",
    "account_key", "license_key", "api_token", "user_pass", "db_pass", "db_password", "root_password", "smtp_password", "admin_pw", "master_key", "app_secret",
]
URL_NAMES = ["dsn", "database_url", "endpoint", "broker", "remote", "url", "connection", "redis_url", "mongo_uri", "origin", "proxy", "index_url"]
PLAIN_WORDS = [
    "max_tokens", "token_count", "tokenizer", "key_size", "keyboard_layout", "keyboard", "monkey", "passwordless", "password_min_length", "secret_rotation_days",
    "public_key", "commit", "build_id", "request_id", "etag", "checksum", "integrity", "content_sha256", "trace", "sha256", "digest", "revision", "key_id", "token_type",
    "keys", "passes", "pass_rate", "author", "authors", "compass", "bypass", "hash", "version", "name", "title", "path", "limit", "timeout", "cache_key", "sort_key",
    "primary_key", "foreign_key", "key_path", "token_limit", "password_policy", "password_file", "secret_name", "auth_mode", "fingerprint", "uuid", "span_id", "image",
]
WORDS = "amber basil cedar delta ember fjord gravel hazel ivory jasper kettle linen meadow nickel orchid pebble quartz raven saddle timber umber violet walnut yarrow zephyr anchor breeze copper dagger falcon granite harbor".split()
PLACEHOLDERS = [
    "changeme", "CHANGE_ME", "REPLACE_ME", "replace-me", "placeholder", "placeholder-secret", "example", "example-password", "your-api-key", "YOUR_API_KEY", "insert-key-here",
    "redacted", "REDACTED", "TODO", "todo", "none", "null", "None", "dummy", "xxxxxxxx", "sk-xxxxxxxxxxxxxxxxxxxxxxxx", "********", "***", "...", "<YOUR_API_KEY>", "<token>",
    "[REDACTED]", "[hidden]", "ghp_000000000000000000000000000000000000", "AKIA" + "EXAMPLE" + "KEY000000", "fill-in", "not-a-real-key", "sample-token", "secret-goes-here", "test",
]
HOSTS = ["db.corp.test", "10.1.2.3", "mail.lab.test", "api.site.test", "cache-1.svc.test", "localhost", "git.host.test", "queue.local.test"]
SCHEMES = ["postgres", "mysql", "redis", "amqp", "mongodb", "mongodb+srv", "https", "http", "ftp", "ldap", "smtp", "postgresql+psycopg2"]
USERS = ["app", "svc", "root", "admin", "deploy", "ci", "bot", "reporter", "app_rw", "user1", ""]
PROSE = "the a of to and reads every file before it runs on each host while our team keeps this page short and lists columns by header for one reader".split()


class Lines:
    """Draws (text, labels, previous line)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def chars(self, alphabet: str, least: int, most: int) -> str:
        return "".join(self.r.choice(alphabet) for _ in range(self.r.randint(least, most)))

    def password(self) -> str:
        r, kind = self.r, self.r.randrange(8)
        if kind < 3:
            a, b = r.choice(WORDS), r.choice(WORDS)
            a = a.capitalize() if r.random() < 0.7 else a
            if r.random() < 0.3:
                a = a.replace("e", "3", 1)
            return a + r.choice(["", "!", "-", "_", "#", "."]) + b + str(r.randint(1, 9999)) + r.choice(["", "!", "?", "$", "*"])
        if kind == 3:
            return "-".join(r.choice(WORDS) for _ in range(4)) + str(r.randint(1, 99))
        if kind == 4:
            return self.chars(HEX, *r.choice([(32, 32), (40, 40), (64, 64), (24, 64)]))
        if kind == 5:
            return self.chars(ALNUM + "!#$^*?_-+", 11, 20)
        return self.chars(ALNUM, 10, 44)

    def vendor(self) -> str:
        prefix, alphabet, least, most = self.r.choice(VENDORS)
        v = prefix + self.chars(alphabet, least, most)
        if prefix.startswith("xox"):
            v += "-" + self.chars(ALNUM, 16, 26)
        if prefix == "SG.":
            v += "." + self.chars(URLSAFE, 40, 44)
        if prefix == "eyJ":
            v += ".eyJ" + self.chars(URLSAFE, 20, 80) + "." + self.chars(URLSAFE, 30, 44)
        return v

    def secret(self) -> str:
        return self.vendor() if self.r.random() < 0.45 else self.password()

    def reference(self) -> str:
        n, r = self.r.choice(SECRET_WORDS), self.r
        up = n.upper()
        return r.choice([
            f"${{{up}}}", f"${up}", f"$({r.choice(['pass show', 'op read', 'cat', 'vault read'])} {r.choice(WORDS)}/{r.choice(WORDS)})", f"{{{{ secrets.{up} }}}}", f"env:{up}", f"vault:kv/{r.choice(WORDS)}#value",
            f"keyring://{r.choice(WORDS)}/{r.choice(WORDS)}", f"/run/secrets/{n}", f"arn:store:secret:{r.choice(WORDS)}", f"postgres://svc:${{{up}}}@{r.choice(HOSTS)}/main", f"https://bot@{r.choice(HOSTS)}/x", f"<%= ENV['{up}'] %>",
            f"file:///etc/{r.choice(WORDS)}", f"secretsmanager:{r.choice(WORDS)}", "prompt", f"@{r.choice(WORDS)}.txt", f"%({n})s", f"sm://project/{r.choice(WORDS)}",
        ])

    def digest(self) -> str:
        r = self.r
        return r.choice([self.chars(HEX, 40, 40), self.chars(HEX, 64, 64), "md5:" + self.chars(HEX, 32, 32), "sha256:" + self.chars(HEX, 64, 64), "-".join(self.chars(HEX, n, n) for n in (8, 4, 4, 4, 12)), "sha512-" + self.chars(B64, 40, 60) + "=="])

    def styled(self, name: str) -> str:
        r, parts = self.r, name.split("_")
        form = r.randrange(5)
        if form == 1:
            name = "".join([parts[0], *[p.capitalize() for p in parts[1:]]])
        elif form == 2:
            name = name.upper()
        elif form == 3:
            name = "-".join(parts)
        elif form == 4 and r.random() < 0.4:
            name = "".join(parts)
        if r.random() < 0.25:
            name = r.choice(["app_", "my_", "x-", "X-", "env.", "cfg.", "this.", "process.env.", "PROD_", "github_", "stripe-"]) + name
        return name

    def assign(self, name: str, nk: str, value: list[tuple[str, str]]) -> list[tuple[str, str]]:
        r = self.r
        pk = "p" if nk == "k" else "o"
        q = r.choice(['"', "'", "`", "", '"', "'"])
        inner = [(q, pk), *value, (q, "o")]
        k = r.randrange(13)
        if k == 0:
            return [(r.choice(["", "export ", "readonly ", "set ", "# ", "// ", "; ", "    "]), "o"), (name, nk), (r.choice(["=", " = ", ":", ": ", " := "]), pk), *inner]
        if k == 1:
            return [(r.choice(["const ", "let ", "export const ", "var ", "final String ", "this.", "cfg."]), "o"), (name, nk), (r.choice([" = ", "="]), pk), *inner, (r.choice([";", "", "  # TODO move"]), "o")]
        if k == 2:
            return [("  " * r.randint(0, 3), "o"), ('"', "o"), (name, nk), ('"' + r.choice([": ", " : ", " => ", ":"]), pk), ('"', pk), *value, ('"' + r.choice([",", ""]), "o")]
        if k == 3:
            return [("  " * r.randint(0, 3) + r.choice(["", "- "]), "o"), (name, nk), (": " + r.choice(["", "", "&shared "]), pk), *inner]
        if k == 4:
            return [(r.choice(["os.environ[", "ENV[", "config[", "process.env["]) + '"', "o"), (name, nk), ('"] = ', pk), *inner]
        if k == 5:
            return [(r.choice(["client = Client(", "connect(host='h', ", "login(user, "]), "o"), (name, nk), ("=", pk), ('"', pk), *value, ('")', "o")]
        if k == 6:
            return [(r.choice(["run-job ", "tool login ", "docker login -u ci ", "deploy --env prod ", "python scripts/job.py ", "invocation: python scripts/job.py ", 'os.system("docker login -u ci ']), "o"), ("--" + name, nk), (r.choice([" ", "=", " '"]), pk), *value, (r.choice(["", " registry.test", "'"]), "o")]
        if k == 7:
            return [("curl -s -d '", "o"), (name, nk), ("=", pk), *value, ("' https://collect.test/v1", "o")]
        if k == 8:
            return [("    " * r.randint(0, 1), "o"), (name, nk), ("=", pk), *value, (" ./run.sh", "o")]
        if k == 9:
            return [(r.choice(["Use the ", "The ", "Set the ", "Our ", "Staging "]), "o"), (name, nk), (r.choice([" `", " is ", " is `", ": ", " `"]), pk), *value, (r.choice(["` when asked.", " for now", ".", "`"]), "o")]
        if k == 10:
            return [("process.env.", "o"), (name, nk), (" ||= ", pk), *inner, (";", "o")]
        if k == 11:
            return [(r.choice(["host=db;user=svc;", "AccountName=store;", "Server=db;Uid=app;"]), "o"), (name, nk), ("=", pk), *value, (r.choice([";", ";EndpointSuffix=core.test", ""]), "o")]
        return [("<" + r.choice(["entry ", "add "]) + 'key="', "o"), (name, nk), ('" value="', pk), *value, ('"/>', "o")]

    def url(self, value: list[tuple[str, str]], good: bool) -> list[tuple[str, str]]:
        r = self.r
        user = r.choice(USERS)
        return [(r.choice(SCHEMES) + "://", "o"), (user, "k" if good else "o"), (":", "p" if good else "o"), *value, ("@" + r.choice(HOSTS) + r.choice(["", ":5432", "/main", ":5432/ledger", "/0"]), "o")]

    def command(self) -> list[tuple[str, str]]:
        r = self.r
        s = [(self.secret(), "s")]
        h = r.choice(HOSTS)
        wrap = r.choice([("", ""), ('os.system("', '")'), ('exec("', '");'), ("    ", ""), ("  run: ", "")])
        k = r.randrange(9)
        if k == 0:
            body = [(f"mysql -h {h} -u root ", "o"), ("-p", "k"), (self.chars(ALNUM, 10, 14), "s"), (" ledger", "o")]
        elif k == 1:
            body = [("sshpass ", "o"), ("-p", "k"), (" '", "p"), *s, (f"' scp a.txt bot@{h}:/tmp", "o")]
        elif k == 2 and r.random() < 0.5:
            lead = r.choice(["python scripts/", "invocation: python scripts/", "node lib/", "bash bin/"]) + r.choice(WORDS) + ".py "
            body = [(lead, "o"), (r.choice(["--user", "-u", "--auth", "--login"]), "k"), (f" {r.choice(['bot', 'admin', 'svc', 'me'])}:", "p"), (r.choice([self.password(), self.chars(ALNUM, 12, 18)]), "s"), (r.choice(["", f" --limit {r.randint(1, 900)}", " --in a.csv"]), "o")]
        elif k == 2:
            body = [("curl ", "o"), (r.choice(["-u", "--user"]), "k"), (f" {r.choice(['bot', 'admin', 'svc'])}:", "p"), (self.password(), "s"), (f" https://{h}/export", "o")]
        elif k == 3:
            body = [(r.choice(["curl -H 'Authorization", "wget --header='Authorization", "-H 'Proxy-Authorization"]), "k"), (": Bearer ", "p"), *s, (f"' https://{h}/v2/list", "o")]
        elif k == 4:
            plain = f"svc:{self.password()}".encode()
            body = [(r.choice(["wget --header='Authorization", "curl -H 'Authorization"]), "k"), (": Basic ", "p"), (base64.b64encode(plain).decode(), "s"), (f"' https://{h}/dump", "o")]
        elif k == 5:
            body = [(r.choice([f"machine {h} login bot ", "default login me ", "login bot "]), "o"), ("password", "k"), (" ", "p"), (self.password(), "s")]
        elif k == 6:
            body = [(r.choice(["pip install --index-url ", "git clone ", "git remote add origin "]), "o"), *self.url([(self.password(), "s")], True), (" tidy", "o")]
        elif k == 7:
            body = [("curl -H '", "o"), (r.choice(["X-Api-Key", "x-auth-token", "PRIVATE-TOKEN", "X-Vault-Token"]), "k"), (": ", "p"), *s, (f"' https://{h}", "o")]
        else:
            body = [(r.choice(["python x.py --password ", "invocation: python scripts/x.py --token ", "login --secret "])[:-1].rsplit(" ", 1)[0] + " ", "o"), (r.choice(["--password", "--token", "--api-key", "--secret", "--pass"]), "k"), (r.choice([" ", " '", "="]), "p"), *s]
        return [(wrap[0], "o"), *body, (wrap[1], "o")]

    def negative_command(self) -> list[tuple[str, str]]:
        r = self.r
        h = r.choice(HOSTS)
        ref = r.choice([self.reference(), r.choice(PLACEHOLDERS)])
        if r.random() < 0.35:
            flag = r.choice([*PLAIN_WORDS, "commit", "sha", "rev", "checksum", "digest", "build-id", "max-tokens", "run-id", "ref", "tag", "limit", "in", "user"]).replace("_", "-")
            value = r.choice([self.chars(HEX, 40, 40), self.digest(), self.digest(), str(r.randint(1, 9999)), r.choice(WORDS)])
            lead = r.choice(["invocation: python scripts/", "python scripts/", "node lib/", "bash bin/", "./"]) + r.choice(WORDS) + r.choice([".py", ".js", ".sh"])
            return [(f"{lead} --{flag}{r.choice([' ', '=', ' '])}{value}{r.choice(['', ' --limit 5', ' --in a.csv'])}", "o")]
        if r.random() < 0.1:
            return [(r.choice(["git checkout ", "git show ", "git cherry-pick ", "commit "]) + self.chars(HEX, 40, 40), "o")]
        return [(r.choice([
            f"mysql -h {h} -u root -p ledger", f"mysql -u root -p${{DB_PASS}} ledger", f"sshpass -e scp a.txt bot@{h}:/tmp", f"curl -u bot:{ref} https://{h}", f"curl -H 'Authorization: Bearer {ref}' https://{h}", f"tool --password-file /run/secrets/pw", f"tool --token {ref}",
            f"mkdir -p build/{r.choice(WORDS)}", f"sort -k{r.randint(1, 9)} entries.log | uniq -c", f"docker login -u ci --password-stdin registry.test", f"python scripts/{r.choice(WORDS)}.py --in {r.choice(WORDS)}.csv", f"git clone https://{h}/a/b.git", f"curl -s https://{h}/{r.randint(1, 99)} -o x.json",
            f"tool --user bot:{ref} --limit 4", f"cp {r.choice(WORDS)}.xml out/", f"    with open('{r.choice(WORDS)}.lst') as fh:", f"def {r.choice(WORDS)}_{r.choice(WORDS)}(rows, limit={r.randint(1, 99)}):", f"ssh-keygen -t ed25519 -C bot@{h}", f"tool --dsn mysql://rw:${{DB_PASS}}@{h}/x",
        ]), "o")]

    def public(self) -> list[tuple[str, str]]:
        r = self.r
        return [(r.choice([
            "ssh-ed25519 AAAAC3" + self.chars(B64, 50, 70) + " bot@host", "ssh-rsa AAAAB3" + self.chars(B64, 60, 90) + "== me@host", "-----BEGIN PUBLIC KEY-----", "-----BEGIN CERTIFICATE-----", "-----END CERTIFICATE-----", "-----END PRIVATE KEY-----", "-----BEGIN CERTIFICATE REQUEST-----",
            *["    " * r.randrange(2) + self.chars(B64, 64, 64) for _ in range(3)], *["    " * r.randrange(2) + self.chars(r.choice([B64, ALNUM]), 20, 76) + r.choice(["", "=", "=="]) for _ in range(3)],
        ]), "o")]

    def prose(self) -> list[tuple[str, str]]:
        r = self.r
        words = [r.choice(PROSE + SECRET_WORDS[:12]) for _ in range(r.randint(5, 16))]
        if r.random() < 0.5:
            words.insert(r.randrange(len(words)), r.choice([str(r.randint(1, 900)), r.choice(WORDS) + ".csv", f"`{r.choice(SECRET_WORDS)}`", "Config.Loader2", "v1.2.3", "2024-05-01"]))
        return [(r.choice(["# ", "", "- ", "// "]) + " ".join(words).capitalize() + ".", "o")]

    def pem(self) -> list[tuple[str, str]]:
        r = self.r
        head = "-----BEGIN " + r.choice(["", "RSA ", "EC ", "DSA ", "OPENSSH ", "ENCRYPTED ", "PGP ", "SSH2 ENCRYPTED "]) + "PRIVATE KEY" + r.choice(["", "", " BLOCK"]) + "-----"
        if r.random() < 0.5:
            return [(r.choice(["", "    ", "> "]), "o"), (head, "s")]
        return [(r.choice(["signer = \"", "const key = '", "export SIGNER=", '  "signer": "']), "o"), (head, "s"), ("\\n", "p"), (self.chars(B64, 64, 64), "s"), ("\\n", "p"), (self.chars(B64, 20, 64), "s"), (r.choice(['"', "'", ""]), "o")]

    def draw(self) -> tuple[str, str, str]:
        r, k = self.r, self.r.random()
        prev = ""
        if k < 0.24:
            parts = self.assign(self.styled(r.choice(SECRET_WORDS)), "k", [(self.secret(), "s")])
        elif k < 0.29:
            v = self.secret()
            c = len(v) // 2
            parts = self.assign(self.styled(r.choice(SECRET_WORDS)), "k", [(v[:c], "s"), (r.choice(['" + "', "' + '", '" "', '", "', "' . '"]), "p"), (v[c:], "s")])
        elif k < 0.34:
            parts = self.assign(self.styled(r.choice(URL_NAMES)), "o", self.url([(self.password(), "s")], True))
        elif k < 0.44:
            parts = self.command()
        elif k < 0.47:
            parts = self.pem()
        elif k < 0.50:
            parts = self.assign(self.styled(r.choice(URL_NAMES + PLAIN_WORDS[:6])), "o", [(self.vendor(), "s")])
        elif k < 0.53:
            good = r.random() < 0.6
            prev = f"    - name: {self.styled(r.choice(SECRET_WORDS if good else PLAIN_WORDS))}"
            parts = [("      ", "o"), ("value", "k" if good else "o"), (": '", "p" if good else "o"), (self.password() if good else self.digest(), "s" if good else "o"), ("'", "o")]
        elif k < 0.66:
            name = self.styled(r.choice(SECRET_WORDS))
            value = r.choice([r.choice(PLACEHOLDERS), self.reference(), self.reference(), "", r.choice(TEST_VENDORS) + self.chars(ALNUM, 24, 24)])
            parts = [(t, "o" if lab == "p" and not value else lab) for t, lab in self.assign(name, "k", [(value, "o")])]
        elif k < 0.80:
            value = r.choice([self.digest(), self.digest(), str(r.randint(1, 9999)), "word-piece", "none", "false", "true", "qwertz", r.choice(WORDS), self.public()[0][0], r.choice(WORDS) + ".csv"])
            parts = self.assign(self.styled(r.choice(PLAIN_WORDS)), "o", [(value, "o")])
        elif k < 0.84:
            parts = self.assign(self.styled(r.choice(URL_NAMES)), "o", self.url([(r.choice(["${DB_PASS}", "<password>", "********", "$PW", "changeme", "{{ pw }}"]), "o")], False) if r.random() < 0.6 else [(f"https://bot@{r.choice(HOSTS)}/x", "o")])
        elif k < 0.885:
            parts = self.negative_command()
        elif k < 0.935:
            parts = self.public()
        elif k < 0.96:
            parts = [(f'  "{r.choice(WORDS)}_{r.choice(WORDS)}_{r.randint(1, 999)}": {r.choice(["null", "true", str(r.randint(1, 900)), chr(34) + r.choice(WORDS) + ".lst" + chr(34)])},', "o")]
        else:
            parts = self.prose()
        text = "".join(t for t, _ in parts)
        return text, "".join(lab * len(t) for t, lab in parts), prev
