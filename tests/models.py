"""Sequential reference models (plain Python) for the order-dependent operators."""

from __future__ import annotations

from decimal import Decimal

DEBIT = {"saque", "pagamento", "transferência", "PIX"}
CREDIT = {"depósito", "estorno"}


def _d(x) -> Decimal | None:
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


def post_model(accounts: dict[int, tuple], txns: list[tuple]) -> dict:
    """accounts: num_conta -> (saldo, tipo_conta, limite); txns: (seq, num_conta, tipo, valor[, number]).

    Returns seq -> (status, balance after or None).
    """
    bal = {k: _d(v[0]) for k, v in accounts.items()}
    taken: set = set()
    out = {}
    for row in sorted(txns):
        seq, acct, tipo, valor = row[:4]
        number = row[4] if len(row) > 4 else None
        if acct not in accounts:
            out[seq] = ("UNKNOWN_ACCOUNT", None)
            continue
        if number is not None and (acct, number) in taken:
            out[seq] = ("DUPLICATE_NUMBER", bal[acct])
            continue
        v = _d(valor)
        b = bal[acct]
        tipo_conta, limite = accounts[acct][1], accounts[acct][2]
        if tipo in DEBIT:
            floor = -(_d(limite) or Decimal("0")) if tipo_conta == "conta especial" else Decimal("0")
            if b is not None and b - v < floor:
                out[seq] = ("CREDIT_LIMIT_EXCEEDED" if tipo_conta == "conta especial" else "INSUFFICIENT_FUNDS", b)
                continue
            bal[acct] = None if b is None else b - v
        elif tipo in CREDIT:
            bal[acct] = None if b is None else b + v
        if number is not None:
            taken.add((acct, number))
        out[seq] = ("ACCEPTED", bal[acct])
    return out


def transfers_model(accounts: dict[int, tuple], singles: list[tuple], transfers: list[tuple],
                    mode: str = "as_written") -> dict:
    """singles: (seq, num_conta, tipo, valor); transfers: (seq, origem, destino, valor). seq -> status."""
    bal = {k: _d(v[0]) for k, v in accounts.items()}

    def test(acct, delta, debit):
        if acct not in accounts:
            return "UNKNOWN_ACCOUNT"
        tipo_conta, limite = accounts[acct][1], accounts[acct][2]
        floor = -(_d(limite) or Decimal("0")) if tipo_conta == "conta especial" else Decimal("0")
        b = bal[acct]
        if debit and b is not None and b + delta < floor:
            return "CREDIT_LIMIT_EXCEEDED" if tipo_conta == "conta especial" else "INSUFFICIENT_FUNDS"
        return None

    def apply(acct, delta):
        if bal[acct] is not None:
            bal[acct] = bal[acct] + delta

    events = [(s[0], "s", s) for s in singles] + [(t[0], "t", t) for t in transfers]
    out = {}
    for seq, kind, row in sorted(events, key=lambda e: e[0]):
        if kind == "s":
            _, acct, tipo, valor = row
            v = _d(valor)
            debit = tipo in DEBIT
            delta = -v if debit else (v if tipo in CREDIT else Decimal("0"))
            why = test(acct, delta, debit)
            if why is None:
                apply(acct, delta)
            out[seq] = why or "ACCEPTED"
        else:
            _, o, d, valor = row
            v = _d(valor)
            why = test(o, -v, True)
            if why is None:
                apply(o, -v)
                dd = -v if mode == "as_written" else v
                why = test(d, dd, mode == "as_written")
                if why is None:
                    apply(d, dd)
                else:
                    apply(o, v)  # roll back the origin leg
            out[seq] = why or "ACCEPTED"
    return out
