"""Vocabularies of the lexer. All are fixed values; callers may pass their own tables instead."""

from __future__ import annotations

# Advisory houses; after a colon the forms that stand for a house, where they are not its name alone.
HOUSES = """
Goldman Sachs: Goldman Sachs; Goldman, Sachs; Goldman Sach; GS&Co
J.P. Morgan: J.P. Morgan; J.P.Morgan; JPMorgan; JP Morgan; J. P. Morgan; JPM
Morgan Stanley
BofA Securities: BofA Securities; BofA Merrill Lynch; BofA; Merrill Lynch; Bank of America Merrill Lynch; Bank of America Securities; Bank of America; BAML
Citi: Citigroup; Citi; Citibank
Credit Suisse
Barclays
UBS
Deutsche Bank
Lazard
Evercore
Centerview
Moelis
PJT Partners: PJT Partners; PJT
Perella Weinberg: Perella Weinberg; PWP
Guggenheim
Jefferies
Houlihan Lokey: Houlihan Lokey; Houlihan
RBC Capital Markets: RBC Capital Markets; RBCCM; RBC
Wells Fargo: Wells Fargo Securities; Wells Fargo
Piper Sandler: Piper Sandler; Piper Jaffray
Sandler O'Neill: Sandler O'Neill; Sandler O’Neill
Raymond James
KBW: Keefe, Bruyette & Woods; Keefe, Bruyette and Woods; KBW
Stifel
Cowen
Leerink
Qatalyst
Allen & Company: Allen & Company; Allen & Co.
Duff & Phelps
Kroll
Greenhill
William Blair
KeyBanc: KeyBanc; KBCM
Truist
SunTrust Robinson Humphrey: SunTrust Robinson Humphrey; SunTrust
Janney
Baird: Robert W. Baird; Baird
Needham
Lincoln International
Macquarie
BMO: BMO Capital Markets; BMO
TD Securities
Mizuho
MUFG
Nomura
B. Riley
Oppenheimer
Canaccord
Craig-Hallum
Roth: Roth Capital; ROTH
Ladenburg Thalmann: Ladenburg
Stephens: Stephens Inc; Stephens
LionTree
Ducera
FT Partners: Financial Technology Partners; FT Partners
Hovde
Boenning & Scattergood: Boenning
Wedbush
Northland
Imperial Capital
Cantor Fitzgerald
Tudor Pickering Holt: Tudor, Pickering, Holt; Tudor Pickering Holt; TPH
Petrie Partners
Peter J. Solomon
Rothschild
Santander
HSBC
BNP Paribas
Societe Generale: Société Générale; Societe Generale
Marathon Capital
Gordon Dyal
Mooreland Partners: Mooreland
JMP Securities
D.A. Davidson
Dougherty
Chardan
H.C. Wainwright
Maxim Group
Alantra
Blackstone: Blackstone Advisory
Union Square Advisors: Union Square
Gleacher
Simmons: Simmons & Company; Simmons
Brean Capital: Brean
Seaport
Berkshire Capital
Capital One Securities
Fifth Third: Fifth Third Securities
Huntington: Huntington Capital Markets
ING: ING Bank
Natixis
Scotiabank: Scotia Capital; Scotiabank
CIBC
National Bank: National Bank Financial
"""

# What follows a house's name where it names a publication, not the house.
PUBLICATIONS = ["Valuation Handbook", "Cost of Capital", "Risk Premium", "Size Study", "Navigator"]

# By rule: a price or a value of equity of a later time, and price targets, at their present value.
_FUTURE = [" ".join(f"present value(s) of {article} {kind} future {what}".split()) for article in ("", "a", "an", "the") for kind in ("", "illustrative", "projected", "illustrative projected") for what in ("stock", "share", "equity")]
_TARGETS = [" ".join(f"{verb} {article} {by} {what} price target(s)".split()) for verb in ("discounted", "discounting") for article in ("", "the") for by in ("", "analyst") for what in ("", "stock", "share")]
# Words that name an analysis, by class.
ANALYSES = {
    "ddm": ["dividend discount", "DDM", "discounted dividend", "net present value analysis", "net present value analyses", "net present value per share"],
    "pv_future_price": [*_FUTURE, "future stock price", "future share price", *_TARGETS, "discounted equity value"],
    "nav": ["net asset value", "NAV"],
    "dcf": ["discounted cash flow", "DCF", "sum-of-the-parts", "sum of the parts", "unlevered free cash flow"],
    "other": ["selected companies", "selected publicly traded companies", "comparable companies", "comparable company", "public trading", "precedent transaction", "selected transaction", "premiums paid", "premium paid", "contribution analysis", "leveraged buyout", "LBO", "accretion", "historical stock price", "historical share price", "historical trading", "trading multiples", "returns analysis"],
}

# Stems of verbs by which a house acts, and words that may come before them.
ACTS = ["perform", "conduct", "calculat", "appl", "deriv", "use", "using", "assum", "utiliz", "select", "discount", "review", "estimat", "valu", "prepar", "also", "then", "analy", "noted", "consider", "determin", "compar"]

# Phrases that name what a value is. Blanks stand for white space or a hyphen, (s) for an ending that may lack.
CUES = {
    "discount": ["cost(s) of capital", "cost(s) of equity", "discount range(s)", "discount rate(s)", "WACC", "weighted average cost(s) of capital"],
    "growth opens": ["perpetual", "perpetuity", "terminal", "terminal value"],
    "growth closes": ["growth", "growth rate(s)"],
    "growth": ["dividend growth rate(s)", "growth rate(s) in perpetuity", "long term dividend growth rate(s)", "perpetuity rate(s)"],
    "exit opens": ["exit", "terminal"],
    "exit closes": ["multiple(s)", "multiple(s) method", "ratio(s)"],
    # a multiple that is no terminal one by its own words: terminal values come behind it, or it is told again
    "multiple leads": ["multiple(s) of", "multiple(s) range of", "multiple(s) ranging from"],
    "told again": ["earnings multiple(s) range of", "earnings per share multiple(s) range of", "EPS multiple(s) range of", "price multiple(s) range of", "price per share multiple(s) range of"],
    "worked out": ["applied", "apply", "applying", "based on", "multiple", "multiples", "multiplied", "multiplying", "selected", "used", "using", "utilized", "utilizing"],
    # between "implied" and its cue
    "fillers": ["a", "an", "the", "illustrative", "range", "range of", "of"],
    "reserve": ["federal reserve", "prime", "reserve bank", "window"],
}

# Words of an advisor's fee, and words that say a sentence is about some other payment: own groups, by what is paid.
_EARLIER = [f"{when} {time}" for when in ("past", "prior", "previous", "preceding", "last") for time in ("two", "three", "several", "year(s)", "two year(s)", "three year(s)")]
FEE_WORDS = {
    "fee": ["compensation", "fee(s)"],
    "other": [
        # between the parties of the deal
        "termination", "break up", "breakup",
        # for earlier or other work of the house
        *_EARLIER, "two year", "three year", "two years preceding", "unrelated", "have received", "received fee(s)", "received aggregate fee(s)", "received an aggregate fee", "received compensation", "recognized", "recognised",
        # for lending and selling securities
        "financing(s)", "capital raise(s)", "capital raising", "underwrite", "underwriter(s)", "underwriting", "placement agent(s)", "lead arranger(s)", "book runner(s)", "bookrunner(s)", "book manager(s)", "co manager(s)",
        # of costs, and to others than the house
        "expenses", "reimburse", "reimbursed", "reimbursement", "director(s)", "solicit", "soliciting", "solicitor(s)", "solicitation", "portfolio companies", "tendered",
        # not agreed
        "may pay", "additional fee",
    ],
}

# What the words around an amount of money do: own vocabulary, by the part that a word plays. Blanks stand for white space or a hyphen.
MONEY_MARKS = {
    # an advisor's pay: for what it is, when it falls due, and what else a sentence can say of it
    "opinion": ["opinion", "opinions"],
    "given": ["deliver", "delivery", "delivered", "delivering", "render", "rendered", "rendering", "issue", "issued", "issuing", "issuance", "provided", "providing"],
    "closing": ["closing", "completion", "consummation", "consummated", "completed", "effectiveness", "effective time"],
    "depends": ["contingent", "conditional", "conditioned", "payable", "due", "success", "completion fee", "becomes payable"],
    "credit": ["credit", "credited", "creditable", "crediting", "offset"],
    "earlier": ["received", "paid", "reimburse", "reimbursed", "reimbursement", "portion"],
    "more": ["additional", "incremental"],
    "part": ["of which"],
    "rest": ["balance", "remainder", "rest", "another opinion"],
    # a price that holders get
    "receive": ["receive", "receives", "to pay", "will pay", "consideration of", "price of", "cash equal to"],
    "cash": ["cash"],
    "plus": ["and", "plus", "together with"],
    "unlike": [
        "option", "options", "warrant", "warrants", "preferred", "series", "strike", "exercise price", "termination", "liquidation", "fee", "proposal", "initial", "revised", "increase", "increased", "reduced", "premium", "average", "aggregate", "implied", "unaffected",
        "book value", "equity value", "transaction value", "reference price",
    ],
    # a value per share that an analysis gives, and one that a market does
    "derived": ["derived", "illustrative", "implied", "implying", "imputed", "indicated", "indicating", "present value", "present values", "produced", "range of prices", "range of values", "reference range", "resulted", "resulting", "yield", "yielded", "yielding"],
    "market": ["52 week", "closing price", "closing prices", "closing stock price", "trading price", "trading prices", "trading range", "traded", "price target", "price targets", "target price", "high and low", "low to high", "per share consideration", "implied consideration", "consideration value"],
}

# General words for parties.
PARTIES = {
    "counter": ["Acquirer", "Acquiror", "Acquisition Corp", "Buyer", "Merger Sub", "Parent", "Purchaser"],
    "pro forma": ["combined business", "combined company", "combined entity", "combined", "pro forma"],
}


def houses() -> dict[str, str]:
    """Form to house."""
    out = {}
    for line in HOUSES.strip().splitlines():
        name, _, forms = line.partition(":")
        for form in forms.split(";") if forms else [name]:
            out[form.strip()] = name
    return out
