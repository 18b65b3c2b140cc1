"""Four families of records from a deterministic generator, and the digests that published receipts give for them."""

from __future__ import annotations

# Copybooks and digests.
MEMBERS = {"ACCTNAME": '          05 :P:-NAME    PIC X(20).\n          05 :P:-TIER    PIC X.\n             88 :P:-GOLD  VALUE "G".\n'}
COPYBOOKS = {
    "account": """       01 ACCOUNT-RECORD.
          05 ACCOUNT-ID    PIC 9(6).
          05 STATUS-CODE   PIC X.
             88 ACTIVE      VALUE "A".
             88 CLOSED      VALUE "C".
             88 DELINQUENT  VALUE "D".
          05 BALANCE       PIC S9(7)V99 COMP-3.
          COPY ACCTNAME REPLACING ==:P:== BY ==CUST==.
          05 BRANCH-NO      PIC 9(4) COMP.
          05 RISK-SCORE     PIC 9(6) COMP-X.
          05 INTERNAL-ID    PIC S9(9) COMP-5.
          05 PRINT-BAL      PIC ZZ,ZZ9.99.
          05 ACCOUNT-SEQUENCE PIC 9(8) COMP-6.
""",
    "payroll": """       01 PAYROLL-RECORD.
          05 EMP-ID       PIC 9(5).
          05 DEPT         PIC X(4).
          05 PAY-TYPE     PIC X.
             88 SALARIED   VALUE "S".
             88 HOURLY     VALUE "H".
          05 GROSS-PAY    PIC S9(7)V99 COMP-3.
          05 DEDUCTIONS   PIC S9(5)V99 COMP-3.
          05 EMPLOYEE-NO    PIC 9(6) COMP.
          05 HOURS-BUCKET   PIC S9(4) COMP-5.
          05 DEDUCT-EDIT    PIC ZZ9.99CR.
          05 PAYROLL-BATCH-NO PIC 9(6) COMP-6.
""",
    "insurance": """       01 POLICY-RECORD.
          05 POLICY-NO     PIC X(10).
          05 RISK-CLASS    PIC 9.
             88 LOW-RISK    VALUE 1 THRU 3.
             88 HIGH-RISK   VALUE 7 THRU 9.
          05 PREMIUM       PIC S9(6)V99 COMP-3.
          05 TERM-MONTHS   PIC 9(3).
          05 POLICY-SEQUENCE PIC 9(10) COMP-X.
          05 CLAIM-COUNT     PIC 9(4) COMP.
          05 POLICY-EDIT    PIC ZZZ,ZZ9.99.
          05 POLICY-CODE     PIC 9(10) COMP-6.
""",
    "cp500": """       01  ACCOUNT-RECORD.
           05  ACCOUNT-ID     PIC X(6).
           05  STATUS-CODE    PIC X.
               88  ACTIVE      VALUE "A".
               88  CLOSED      VALUE "C".
               88  DELINQUENT  VALUE "D".
           05  CUSTOMER-NAME  PIC X(12).
           05  CUST-TIER      PIC X.
               88  CUST-GOLD   VALUE "G".
           05  BALANCE        PIC S9(7)V99 COMP-3.
           05  BRANCH-NO      PIC 9(4) COMP.
           05  RISK-SCORE     PIC 9(6) COMP-X.
           05  INTERNAL-ID    PIC S9(9) COMP-5.
           05 REGION-CODE    PIC 9(3).
           05 LIMIT-AMT      PIC S9(7)V99.
           05 RISK-PERCENT   PIC 9(3)V99.
           05 ACCT-SEQ-C6   PIC 9(8) COMP-6.
""",
}
INPUT_SHA256 = {
    "account": "e6e900f3e3a3443de22cba90e61d6e965ce950a526071267363219b0f82bf30d",
    "payroll": "87df40f23b04e1c3881356e615c41b27ab1c049c5d2313af023801c36ddca0f0",
    "insurance": "dad19ee16821ac71322086735ac007150801deb431cf6d4ab4c254d1daba806c",
    "cp500": "82b8513bef996d00f43ba7cc704c0d911822994ee162986388f11adf35914a37",
}
EXPANDED_SHA256 = {
    "account": "d5d55963fcb7a75858bd2b54087a4a511aacd2de53d1d3ce433f4d7247687c13",
    "payroll": "6015bf71889f670b20e8ee7be9a596b5a4d17d3945d558030ac0af0efe201a94",
    "insurance": "4b10a449cea1767570bf90c48f481f11d0daab978e95ad82c7852c268856b25a",
    "cp500": "ccc7592f93b640c702f025002a3384c0301f2838513ed96f430d5ab543a5b809",
}
LAYOUT_HASH = {
    "account": "0d58564d894d27a52fda53944e33a7cffcc4af18e95e6daab1123da65d6e3364",
    "payroll": "268d1399d66100fa063ce94d58b8dd016b19a4f26b78c6ea09a733a044c85f49",
    "insurance": "f11e418861326fc3a6a3b1671b1514a1b4698a89869c84e00d0c15c7ddd19842",
    "cp500": "b2b8f3802810fbbf5fabfc29a7e2c89d5349c87b544bcc41be5fdb198ab03345",
}
#: Of the decoded JSON lines; the other families' lines carry another project's label, so they are compared by value.
OUTPUT_SHA256 = {"cp500": "28e24dbc11fd26d17c4de367d53462ed40855c180df9a85e81d9ab7da17b7db2"}
RECORD_LEN = {"account": 55, "payroll": 36, "insurance": 41, "cp500": 55}
ENCODING = {"account": "ascii", "payroll": "ascii", "insurance": "ascii", "cp500": "cp500"}
SEEDS = {"account": 0xACC00001, "payroll": 0x9A700001, "insurance": 0x1A500001, "cp500": 0xC0500001}


def draws(seed: int):
    """The published linear congruential generator: next(n) is below n."""
    state = seed

    def below(n: int) -> int:
        nonlocal state
        state = (state * 6364136223846793005 + 1442695040888963407) % 2**64
        return (state >> 16) % n

    return below


def rows(family: str, n: int = 120) -> list[tuple[str, ...]]:
    """Each record's values as text, in field order. These recipes give the bytes of the digests above."""
    below = draws(SEEDS[family])
    sign = lambda k: "-" if below(k) == 0 else ""
    money = lambda n, plus=0: f"{plus + below(n)}.{below(100):02d}"
    out = []
    for i in range(n):
        if family == "account":
            balance = sign(4) + money(9_999_999)
            branch, risk = str(1000 + below(8999)), str(below(999999))
            ident = sign(3) + str(below(999999999))
            out.append((f"{100000 + i}", "ACDAA"[i % 5], balance, f"CUSTOMER {i:04d}", "GSS"[i % 3], branch, risk, ident, money(99999), str(10_000_000 + i)))
        elif family == "payroll":
            gross, less = money(80000, 2000), money(9000)
            hours = sign(4) + str(below(2000))
            out.append((f"{10000 + i}", ("ENG", "SALE", "OPS", "HR")[i % 4], "SHSHS"[i % 5], gross, less, str(100000 + i), hours, sign(3) + money(999), str(200_000 + i)))
        elif family == "insurance":
            risk, premium, term = str(below(9) + 1), money(900000), str(12 + below(48))
            out.append((f"POL{i:07d}", risk, premium, term, str(1_000_000 + i), str(below(50)), money(999999), str(9_000_000_000 + i)))
        else:
            balance = sign(4) + money(9_999_999)
            branch, risk = str(1000 + below(8999)), str(below(999999))
            ident = sign(3) + str(below(999999999))
            region = str(below(1000))
            limit = sign(4) + money(9_999_999)
            out.append((f"{100000 + i}", "ACDAA"[i % 5], f"CUST {i:04d}", "GSS"[i % 3], balance, branch, risk, ident, region, limit, money(1000), str(20_000_000 + i)))
    return out
