"""Registered queries of the functions: each family as one wide query, held against SQL written from the definitions.

Where SQL has no such function, its side is a sum or an integral by Simpson's
rule, so the two sides share nothing but the definition.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventframe.frame import Frame
from eventframe.queries import _table, query

#: Inputs of all families, over suppliers: u in (0, 1), x in (-3, 3), t in (0, 8.05), k a whole number.
_GRID = {"u": "(s_acctbal + 1000.0) / 11000.0", "x": "(s_acctbal + 1000.0) / 11000.0 * 6.0 - 3.0", "t": "(s_acctbal + 1000.0) / 11000.0 * 8.0 + 0.05", "k": "cast(s_suppkey % 7 as double)"}
_GRID_SQL = "with g as (select s_suppkey, " + ", ".join(f"({e})::double {n}" for n, e in _GRID.items()) + " from supplier)"


def _family(name: str, digits: int, **columns: tuple[str, str]) -> None:
    """A query of one column for each (frame expression, SQL)."""

    def run(spark, sf_dir):
        grid = _table(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(e).cast("double").alias(n) for n, e in _GRID.items()])
        f = Frame(grid)
        for c, (expression, _) in columns.items():
            f = f.Define(c, expression)
        out = f.dataframe(["s_suppkey", *columns])
        return out.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})

    run.__name__ = name
    picked = ", ".join(f"round(({sql})::double, {digits}) {c}" for c, (_, sql) in columns.items())
    query(f"{_GRID_SQL} select s_suppkey, {picked} from g")(run)


def _integral(f: str, low: str, high: str, n: int = 400) -> str:
    """Simpson's rule; ``f`` has ``$`` where the variable stands."""
    at = f"(({low}) + (({high}) - ({low})) * i / {n}.0)"
    return f"((({high}) - ({low})) / {3 * n}.0 * list_sum(list_transform(range(0, {n + 1}), lambda i: (case when i = 0 or i = {n} then 1.0 when i % 2 = 1 then 4.0 else 2.0 end) * ({f.replace('$', at)}))))"


def _sum(f: str, low: str, high: str) -> str:
    """Over whole numbers from ``low`` up to ``high``."""
    return f"coalesce(list_sum(list_transform(range(({low})::bigint, ({high})::bigint + 1), lambda i: {f.replace('$', 'i')})), 0.0)"


_PHI = "exp(-0.5 * ($) * ($)) / sqrt(2 * pi())"
_phi = lambda z: _PHI.replace("$", z)
_normal = lambda z: f"(0.5 + {_integral(_PHI, '0.0', z)})"
_erf = lambda z: f"(2 / sqrt(pi()) * {_integral('exp(-($) * ($))', '0.0', z)})"
_CHI5 = "pow($, 1.5) * exp(-($) / 2) / (pow(2, 2.5) * gamma(2.5))"
_GAMMA4 = "pow($, 3) * exp(-($) / 1.5) / (pow(1.5, 4) * gamma(4))"
_CHI6 = "pow($, 2) * exp(-($) / 2) / (pow(2, 3) * gamma(3))"
_T5 = "gamma(3) / (sqrt(5 * pi()) * gamma(2.5)) * pow(1 + ($) * ($) / 5, -3)"
_F47 = "gamma(5.5) / (gamma(2) * gamma(3.5)) * pow(4.0 / 7.0, 2) * ($) * pow(1 + 4.0 / 7.0 * ($), -5.5)"
_B34 = "gamma(7) / (gamma(3) * gamma(4)) * pow($, 2) * pow(1 - ($), 3)"
_POISSON = "exp(-2.5) * pow(2.5, $) / gamma(($) + 1)"
_BINOMIAL = "gamma(10) / (gamma(($) + 1) * gamma(10 - ($))) * pow(0.3, $) * pow(0.7, 9 - ($))"
_LANDAU = "(case when ($) = 0 then 0.0 else 2 * ($) * exp(-pi() / 2 * ($) * ($)) * cos(($) * ($) * (VV) + ($) * ($) * 2 * ln(greatest($, 1e-300))) / pi() end)"
_landau = lambda v: _integral(_LANDAU.replace("VV", v), "0.0", "5.0", 2000)
_Z = "((x - 0.1) / 0.9)"
_CRYSTAL = f"(case when {_Z} > -1.2 then exp(-0.5 * {_Z} * {_Z}) else pow(2.5 / 1.2, 2.5) * exp(-0.72) * pow(2.5 / 1.2 - 1.2 - {_Z}, -2.5) end)"
_CRYSTAL_TAIL, _CRYSTAL_CORE = "(2.5 / 1.2 / 1.5 * exp(-0.72))", f"(sqrt(pi() / 2) * (1 + {_erf('1.2 / sqrt(2.0)')}))"
_CRYSTAL_CDF = f"(case when {_Z} > -1.2 then {_CRYSTAL_TAIL} + sqrt(pi() / 2) * ({_erf(f'{_Z} / sqrt(2.0)')} + {_erf('1.2 / sqrt(2.0)')}) else {_CRYSTAL_TAIL} * pow(1 - ({_Z} + 1.2) * 1.2 / 2.5, -1.5) end / ({_CRYSTAL_TAIL} + {_CRYSTAL_CORE}))"
_KOLMOGOROV = f"(case when t < 0.2 then 1.0 else 2 * {_sum('pow(-1, ($) - 1) * exp(-2 * ($) * ($) * t * t)', '1', '60')} end)"


def _at(f: str, z: str) -> str:
    return "(" + f.replace("$", z) + ")"


_family(
    "cmath_functions", 9,
    abs_=("abs(x)", "abs(x)"), fabs_=("fabs(x)", "abs(x)"), sqrt_=("sqrt(t)", "sqrt(t)"), cbrt_=("cbrt(x)", "cbrt(x)"), pow_=("pow(t, x)", "pow(t, x)"), exp_=("exp(x)", "exp(x)"), exp2_=("exp2(x)", "pow(2, x)"),
    log_=("log(t)", "ln(t)"), log10_=("log10(t)", "log10(t)"), log2_=("log2(t)", "log2(t)"), sin_=("sin(x)", "sin(x)"), cos_=("cos(x)", "cos(x)"), tan_=("tan(u)", "tan(u)"), asin_=("asin(u)", "asin(u)"), acos_=("acos(u)", "acos(u)"), atan_=("atan(x)", "atan(x)"),
    atan2_=("atan2(x, t)", "atan2(x, t)"), sinh_=("sinh(x)", "(exp(x) - exp(-x)) / 2"), cosh_=("cosh(x)", "(exp(x) + exp(-x)) / 2"), tanh_=("tanh(x)", "(exp(2 * x) - 1) / (exp(2 * x) + 1)"), asinh_=("asinh(x)", "ln(x + sqrt(x * x + 1))"), acosh_=("acosh(t + 1)", "ln(t + 1 + sqrt((t + 1) * (t + 1) - 1))"), atanh_=("atanh(u)", "0.5 * ln((1 + u) / (1 - u))"),
    floor_=("floor(x)", "floor(x)"), ceil_=("ceil(x)", "ceil(x)"), trunc_=("trunc(x)", "trunc(x)"), round_=("round(x)", "sign(x) * floor(abs(x) + 0.5)"), rint_=("rint(x * 2)", "round_even(x * 2, 0)"), fmod_=("fmod(x, 0.7)", "x - 0.7 * trunc(x / 0.7)"), hypot_=("hypot(x, t)", "sqrt(x * x + t * t)"),
    min_=("min(x, u)", "least(x, u)"), max_=("max(x, u)", "greatest(x, u)"), fmin_=("fmin(x, u)", "least(x, u)"), fmax_=("fmax(x, u)", "greatest(x, u)"), erf_=("erf(x)", _erf("x")), erfc_=("erfc(x)", f"1 - {_erf('x')}"), tgamma_=("tgamma(t)", "gamma(t)"), lgamma_=("lgamma(t)", "lgamma(t)"),
    isnan_=("isnan(x) ? 1 : 0", "0"), isinf_=("isinf(1 / (k - 3)) ? 1 : 0", "case when k = 3 then 1 else 0 end"), isfinite_=("isfinite(1 / (k - 3)) ? 1 : 0", "case when k = 3 then 0 else 1 end"), sq_=("sq(x)", "x * x"), std_=("std::sqrt(t) + std::cos(x)", "sqrt(t) + cos(x)"),
)
_family(
    "tmath_functions", 9,
    abs_=("TMath::Abs(x)", "abs(x)"), sqrt_=("TMath::Sqrt(t)", "sqrt(t)"), sq_=("TMath::Sq(x)", "x * x"), power_=("TMath::Power(t, x)", "pow(t, x)"), exp_=("TMath::Exp(x)", "exp(x)"), log_=("TMath::Log(t)", "ln(t)"), log10_=("TMath::Log10(t)", "log10(t)"), log2_=("TMath::Log2(t)", "log2(t)"),
    sin_=("TMath::Sin(x)", "sin(x)"), cos_=("TMath::Cos(x)", "cos(x)"), tan_=("TMath::Tan(u)", "tan(u)"), asin_=("TMath::ASin(u)", "asin(u)"), acos_=("TMath::ACos(u)", "acos(u)"), atan_=("TMath::ATan(x)", "atan(x)"), atan2_=("TMath::ATan2(x, t)", "atan2(x, t)"), sinh_=("TMath::SinH(x)", "(exp(x) - exp(-x)) / 2"), cosh_=("TMath::CosH(x)", "(exp(x) + exp(-x)) / 2"),
    tanh_=("TMath::TanH(x)", "(exp(2 * x) - 1) / (exp(2 * x) + 1)"), asinh_=("TMath::ASinH(x)", "ln(x + sqrt(x * x + 1))"), acosh_=("TMath::ACosH(t + 1)", "ln(t + 1 + sqrt((t + 1) * (t + 1) - 1))"), atanh_=("TMath::ATanH(u)", "0.5 * ln((1 + u) / (1 - u))"), min_=("TMath::Min(x, u)", "least(x, u)"), max_=("TMath::Max(x, u)", "greatest(x, u)"),
    floor_=("TMath::Floor(x)", "floor(x)"), ceil_=("TMath::Ceil(x)", "ceil(x)"), nint_=("TMath::Nint(x)", "round_even(x, 0)"), sign_=("TMath::Sign(t, x)", "case when x >= 0 then t else -t end"), hypot_=("TMath::Hypot(x, t)", "sqrt(x * x + t * t)"), erf_=("TMath::Erf(x)", _erf("x")), erfc_=("TMath::Erfc(x)", f"1 - {_erf('x')}"), gamma_=("TMath::Gamma(t)", "gamma(t)"), lngamma_=("TMath::LnGamma(t)", "lgamma(t)"),
    gaus_=("TMath::Gaus(x, 0.2, 1.5)", "exp(-0.5 * pow((x - 0.2) / 1.5, 2))"), breitwigner_=("TMath::BreitWigner(x, 0.3, 1.2)", "0.6 / (pi() * (pow(x - 0.3, 2) + 0.36))"), isnan_=("TMath::IsNaN(x) ? 1 : 0", "0"), finite_=("TMath::Finite(1 / (k - 3)) ? 1 : 0", "case when k = 3 then 0 else 1 end"), even_=("TMath::Even(k) ? 1 : 0", "case when k::int % 2 = 0 then 1 else 0 end"), odd_=("TMath::Odd(k) ? 1 : 0", "k::int % 2"),
    pi_=("TMath::Pi()", "pi()"), twopi_=("TMath::TwoPi()", "2 * pi()"), piover2_=("TMath::PiOver2()", "pi() / 2"), piover4_=("TMath::PiOver4()", "pi() / 4"), invpi_=("TMath::InvPi()", "1 / pi()"), e_=("TMath::E()", "exp(1.0)"), ln10_=("TMath::Ln10()", "ln(10.0)"), loge_=("TMath::LogE()", "log10(exp(1.0))"), sqrt2_=("TMath::Sqrt2()", "sqrt(2.0)"), degtorad_=("TMath::DegToRad()", "pi() / 180"), radtodeg_=("TMath::RadToDeg()", "180 / pi()"), c_=("TMath::C()", "299792458.0"),
    floornint_=("TMath::FloorNint(x)", "floor(x)"), ceilnint_=("TMath::CeilNint(x)", "ceil(x)"), quietnan_=("TMath::IsNaN(TMath::QuietNaN()) ? 1 : 0", "1"), signalingnan_=("TMath::IsNaN(TMath::SignalingNaN()) ? 1 : 0", "1"), infinity_=("TMath::Infinity() > t ? 1 : 0", "1"), areequalabs_=("TMath::AreEqualAbs(x, u, 0.5) ? 1 : 0", "case when abs(x - u) < 0.5 then 1 else 0 end"), areequalrel_=("TMath::AreEqualRel(t, t * 1.001, 0.01) ? 1 : 0", "1"),
)
_family(
    "tmath_distributions", 7,
    factorial_=("TMath::Factorial(k)", "gamma(k + 1)"), binomial_=("TMath::Binomial(9, k)", "gamma(10) / (gamma(k + 1) * gamma(10 - k))"), binomiali_=("TMath::BinomialI(0.3, 9, k)", _sum(_BINOMIAL, "k", "9")), gamma2_=("TMath::Gamma(3.0, t / 2)", _integral(_CHI6, "0.0", "t")), beta_=("TMath::Beta(t, 2)", "1 / (t * (t + 1))"), betaincomplete_=("TMath::BetaIncomplete(u, 3, 4)", _integral(_B34, "0.0", "u")),
    erfinverse_=("TMath::Erf(TMath::ErfInverse(u))", "u"), erfcinverse_=("TMath::Erfc(TMath::ErfcInverse(u))", "u"), freq_=("TMath::Freq(x)", _normal("x")), normquantile_=("TMath::Freq(TMath::NormQuantile(u))", "u"), landau_=("TMath::Landau(x, 0.2, 1.1, 1)", f"{_landau('((x - 0.2) / 1.1)')} / 1.1"), landau0_=("TMath::Landau(x, 0.2, 1.1)", _landau("((x - 0.2) / 1.1)")),
    breitwignerrelativistic_=("TMath::BreitWignerRelativistic(t, 3, 0.7)", "2 * sqrt(2.0) / pi() * 3 * 0.7 * sqrt(9 * 9.49) / sqrt(9 + sqrt(9 * 9.49)) / (pow(t * t - 9, 2) + 9 * 0.49)"), laplacedist_=("TMath::LaplaceDist(x, 0.2, 1.3)", "exp(-abs(x - 0.2) / 1.3) / 2.6"), laplacedisti_=("TMath::LaplaceDistI(x, 0.2, 1.3)", "case when x <= 0.2 then 0.5 * exp((x - 0.2) / 1.3) else 1 - 0.5 * exp((0.2 - x) / 1.3) end"), cauchydist_=("TMath::CauchyDist(x, 0.3, 1.2)", "1.2 / (pi() * (pow(x - 0.3, 2) + 1.44))"),
    poisson_=("TMath::Poisson(t, 2.5)", "exp(t * ln(2.5) - 2.5 - lgamma(t + 1))"), poissoni_=("TMath::PoissonI(t, 2.5)", _at(_POISSON, "floor(t)")), prob_=("TMath::Prob(t, 6)", f"1 - {_integral(_CHI6, '0.0', 't')}"), kolmogorovprob_=("TMath::KolmogorovProb(t)", _KOLMOGOROV), chisquarequantile_=("1 - TMath::Prob(TMath::ChisquareQuantile(u, 6), 6)", "u"), student_=("TMath::Student(x, 5)", _at(_T5, "x")), studenti_=("TMath::StudentI(x, 5)", f"0.5 + {_integral(_T5, '0.0', 'x')}"), studentquantile_=("TMath::StudentI(TMath::StudentQuantile(u, 5), 5)", "u"),
    fdist_=("TMath::FDist(t, 4, 7)", _at(_F47, "t")), fdisti_=("TMath::FDistI(t, 4, 7)", _integral(_F47, "0.0", "t", 1000)), gammadist_=("TMath::GammaDist(t, 4, 0, 1.5)", _at(_GAMMA4, "t")), lognormal_=("TMath::LogNormal(t, 0.8, 0, 1.3)", f"{_phi('((ln(t) - ln(1.3)) / 0.8)')} / (0.8 * t)"), betadist_=("TMath::BetaDist(u, 3, 4)", _at(_B34, "u")), betadisti_=("TMath::BetaDistI(u, 3, 4)", _integral(_B34, "0.0", "u")),
)
_family(
    "probability_densities", 7,
    gaussian_=("ROOT::Math::gaussian_pdf(x, 1.5, 0.2)", f"{_phi('((x - 0.2) / 1.5)')} / 1.5"), normal_=("ROOT::Math::normal_pdf(x, 1.5, 0.2)", f"{_phi('((x - 0.2) / 1.5)')} / 1.5"), chisquared_=("ROOT::Math::chisquared_pdf(t, 5)", _at(_CHI5, "t")), gamma_=("ROOT::Math::gamma_pdf(t, 4, 1.5)", _at(_GAMMA4, "t")), exponential_=("ROOT::Math::exponential_pdf(t, 0.7)", "0.7 * exp(-0.7 * t)"), exponential0_=("ROOT::Math::exponential_pdf(t, 0.7, 4)", "case when t < 4 then 0.0 else 0.7 * exp(-0.7 * (t - 4)) end"),
    poisson_=("ROOT::Math::poisson_pdf(k, 2.5)", _at(_POISSON, "k")), binomial_=("ROOT::Math::binomial_pdf(k, 0.3, 9)", _at(_BINOMIAL, "k")), landau_=("ROOT::Math::landau_pdf(x, 1.1, 0.2)", f"{_landau('((x - 0.2) / 1.1)')} / 1.1"), breitwigner_=("ROOT::Math::breitwigner_pdf(x, 1.2, 0.3)", "0.6 / (pi() * (pow(x - 0.3, 2) + 0.36))"), cauchy_=("ROOT::Math::cauchy_pdf(x, 1.2, 0.3)", "1.2 / (pi() * (pow(x - 0.3, 2) + 1.44))"), lognormal_=("ROOT::Math::lognormal_pdf(t, 0.3, 0.8)", f"{_phi('((ln(t) - 0.3) / 0.8)')} / (0.8 * t)"),
    tdistribution_=("ROOT::Math::tdistribution_pdf(x, 5)", _at(_T5, "x")), fdistribution_=("ROOT::Math::fdistribution_pdf(t, 4, 7)", _at(_F47, "t")), beta_=("ROOT::Math::beta_pdf(u, 3, 4)", _at(_B34, "u")), uniform_=("ROOT::Math::uniform_pdf(x, -1, 2)", "case when x >= -1 and x < 2 then 1.0 / 3.0 else 0.0 end"), crystalball_function_=("ROOT::Math::crystalball_function(x, 1.2, 2.5, 0.9, 0.1)", _CRYSTAL), crystalball_=("ROOT::Math::crystalball_pdf(x, 1.2, 2.5, 0.9, 0.1)", f"{_CRYSTAL} / (0.9 * ({_CRYSTAL_TAIL} + {_CRYSTAL_CORE}))"),
    bigaussian_=("ROOT::Math::bigaussian_pdf(x, t, 1.1, 1.3, 0.4, 0.1, 0.2)", "exp(-(pow((x - 0.1) / 1.1, 2) - 0.8 * (x - 0.1) / 1.1 * (t - 0.2) / 1.3 + pow((t - 0.2) / 1.3, 2)) / 1.68) / (2 * pi() * 1.1 * 1.3 * sqrt(0.84))"),
)
_CDFS = {
    "gaussian": ("x, 1.5, 0.2", _normal("((x - 0.2) / 1.5)")), "chisquared": ("t, 6", _integral(_CHI6, "0.0", "t")), "gamma": ("t, 4, 1.5", _integral(_GAMMA4, "0.0", "t")), "exponential": ("t, 0.7", "(1 - exp(-0.7 * t))"), "poisson": ("k + u, 2.5", _sum(_POISSON, "0", "k")), "binomial": ("k + u, 0.3, 9", _sum(_BINOMIAL, "0", "k")),
    "breitwigner": ("x, 1.2, 0.3", "(0.5 + atan((x - 0.3) / 0.6) / pi())"), "cauchy": ("x, 1.2, 0.3", "(0.5 + atan((x - 0.3) / 1.2) / pi())"), "lognormal": ("t, 0.3, 0.8", _normal("((ln(t) - 0.3) / 0.8)")), "tdistribution": ("x, 5", f"(0.5 + {_integral(_T5, '0.0', 'x')})"), "fdistribution": ("t, 4, 7", _integral(_F47, "0.0", "t", 1000)), "beta": ("u, 3, 4", _integral(_B34, "0.0", "u")),
    "uniform": ("x, -1, 2", "least(1.0, greatest(0.0, (x + 1) / 3))"), "crystalball": ("x, 1.2, 2.5, 0.9, 0.1", _CRYSTAL_CDF),
}
_family("cumulative_distributions", 7, normal_=("ROOT::Math::normal_cdf(x, 1.5, 0.2)", _CDFS["gaussian"][1]), **{f"{n}_{c}": (f"ROOT::Math::{n}_cdf{'_c' if c else ''}({a})", f"1 - {sql}" if c else sql) for n, (a, sql) in _CDFS.items() for c in ("", "c")})
_QUANTILES = {"gaussian": ("1.5", "1.5, 0"), "chisquared": ("6", "6"), "gamma": ("4, 1.5", "4, 1.5"), "exponential": ("0.7", "0.7"), "tdistribution": ("5", "5"), "fdistribution": ("4, 7", "4, 7"), "beta": ("3, 4", "3, 4")}
_family("quantiles_of_distributions", 8, normal_=("ROOT::Math::normal_cdf(ROOT::Math::normal_quantile(u, 1.5), 1.5, 0)", "u"), **{f"{n}_{c}": (f"ROOT::Math::{n}_cdf{c}(ROOT::Math::{n}_quantile{c}(u, {a}), {b})", "u") for n, (a, b) in _QUANTILES.items() for c in ("", "_c")})
_family(
    "special_functions", 7,
    bessel_j=("ROOT::Math::cyl_bessel_j(k, t)", f"{_integral('cos(k * ($) - t * sin($))', '0.0', 'pi()')} / pi()"), bessel_i=("ROOT::Math::cyl_bessel_i(k, t / 2)", f"{_integral('exp(t / 2 * cos($)) * cos(k * ($))', '0.0', 'pi()')} / pi()"), bessel_k=("ROOT::Math::cyl_bessel_k(1.5, t + 0.5)", "sqrt(pi() / (2 * (t + 0.5))) * exp(-(t + 0.5)) * (1 + 1 / (t + 0.5))"), bessel_half=("ROOT::Math::cyl_bessel_j(0.5, t)", "sqrt(2 / (pi() * t)) * sin(t)"),
    sph=("ROOT::Math::sph_bessel(2, t)", "(3 / pow(t, 3) - 1 / t) * sin(t) - 3 / (t * t) * cos(t)"), legendre_=("ROOT::Math::legendre(3, x / 3)", "(5 * pow(x / 3, 3) - x) / 2"), assoc=("ROOT::Math::assoc_legendre(2, 1, x / 3)", "x * sqrt(1 - x * x / 9)"), sphl=("ROOT::Math::sph_legendre(2, 1, t)", "-sqrt(5 / (24 * pi())) * 3 * cos(t) * abs(sin(t))"), erf_=("ROOT::Math::erf(x)", _erf("x")), erfc_=("ROOT::Math::erfc(x)", f"1 - {_erf('x')}"), tgamma_=("ROOT::Math::tgamma(t)", "gamma(t)"), lgamma_=("ROOT::Math::lgamma(t)", "lgamma(t)"),
    beta_=("ROOT::Math::beta(t, 2)", "1 / (t * (t + 1))"), incgamma=("ROOT::Math::inc_gamma(3, t / 2)", _integral(_CHI6, "0.0", "t")), incgammac=("ROOT::Math::inc_gamma_c(3, t / 2)", f"1 - {_integral(_CHI6, '0.0', 't')}"), incbeta=("ROOT::Math::inc_beta(u, 3, 4)", _integral(_B34, "0.0", "u")),
)


@query(f"{_GRID_SQL} select s_suppkey, round(0.5 + 0.3 * u - 0.2 * (2 * u * u - 1) + 0.1 * (4 * u * u * u - 3 * u), 8) cheb, round(x, 7) solved, round(exp(-0.5 * pow((x - 0.1) / 0.8, 2)) * 2 + sin(t), 8) named from g")
def functions_of_columns(spark, sf_dir):
    """Chebyshev sums, the inverse of a distribution by bisection, and functions given as text with parameters."""
    from eventframe.functions import special
    from eventframe.functions.function import Function
    from eventframe.functions.scalar import arrow

    grid = _table(spark, sf_dir, "supplier").select("s_suppkey", *[F.expr(e).cast("double").alias(n) for n, e in _GRID.items()])
    cheb = arrow(lambda u: special.chebyshev(u, 0.5, 0.3, -0.2, 0.1))(F.col("u"))
    solved = arrow(lambda x: special.inverse(special.normal_cdf, special.normal_cdf(x), x - 9.0, x + 7.0))(F.col("x"))
    named = Function("gaus", -3, 3, [2.0, 0.1, 0.8]).column(F.col("x")) + Function("sin(x)", 0, 9).column(F.col("t"))
    return grid.select("s_suppkey", F.round(cheb, 8).alias("cheb"), F.round(solved, 7).alias("solved"), F.round(named, 8).alias("named"))


@query(f"select * from (values ('integral', round(1.6 * {_integral('exp(-0.5 * ($) * ($))', '-3.875', '3.625')}, 8)), ('place', 0.1::double), ('top', 2.0), ('slope', round(-2 / 0.64 * 0.5 * exp(-0.5 * 0.390625), 6)), ('root', round(sqrt(2.0), 8)), ('power', 17.0)) t(what, value)")
def function_objects(spark, sf_dir):
    """Integral, maximum, derivative and root of functions given as text."""
    from eventframe.functions.function import Function

    bell = Function("gaus", -3, 3, [2.0, 0.1, 0.8])
    place, top = bell.maximum()
    rows = [("integral", round(bell.integral(), 8)), ("place", round(place, 6)), ("top", round(top, 8)), ("slope", round(bell.derivative(0.6), 6)), ("root", round(Function("x^2-2", 0, 2).root(), 8)), ("power", Function("pol2", 0, 9, [1.0, 0.0, 4.0])(2.0))]
    return spark.createDataFrame([(k, float(v)) for k, v in rows], "what string, value double")


@query("select s_suppkey i, round(2.5 * s_suppkey + 1, 6)::double straight, 3.0::double flat from supplier")
def smoothed_arrays(spark, sf_dir):
    """The robust smoother leaves straight and constant arrays as they are."""
    import numpy as np

    from eventframe.hist.compare import smooth

    n = _table(spark, sf_dir, "supplier").count()
    straight, flat = smooth(2.5 * np.arange(n) + 1), smooth(np.full(n, 3.0), 2)
    return spark.createDataFrame([(i, round(float(a), 6), round(float(b), 6)) for i, (a, b) in enumerate(zip(straight, flat))], "i bigint, straight double, flat double")
