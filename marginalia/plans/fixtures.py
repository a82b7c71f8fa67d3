"""Small papers of our own that exercise the scanners; the driver's tables hold no TeX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAPERS = {
    "2701.00001": {
        "main.tex": r"""\documentclass{article}
\newcommand{\Sp}{\mathcal{S}}
\newcommand{\pair}[2]{(#1,#2)}
\newtheorem{thm}{Theorem}[section]
\newaliascnt{lem}{thm}
\newtheorem{lem}[thm]{Lemma}
\newtheorem{note}[thm]{Definition of note}
\newtheorem*{question}{Question}
\title{On shapes of $\Sp$}
\author{Ada One \\ Somewhere \and Bo Two}
\begin{abstract}
Shapes are counted.
\end{abstract}
\begin{document}
\section{Shapes}\label{sec:shapes}
\input{parts/first}
\include{parts/second.tex}
\bibliography{refs}
\end{document}
""",
        "parts/first.tex": r"""% \begin{thm} not a theorem
\begin{thm}[A {nested} title]\label{thm:main}
Every $\Sp$ is round, see \cref{lem:flat, sec:shapes} and \cite[p.~3]{One20,Two21}.
\[ r = 1 \]
\end{thm}
% between statement and proof
\begin{proof}
By \ref{lem:flat} and \eqref{eq:none}. \begin{itemize}\item done\end{itemize}
\end{proof}
""",
        "parts/second.tex": r"""\subsection{Flat ones}
\begin{lem}\label{lem:flat} Flat shapes are few. \end{lem}
\begin{note} A shape is a thing. \end{note}
\begin{question} Are there more? \end{question}
\begin{verbatim}
\begin{thm} also none \end{thm}
\end{verbatim}
""",
        "refs.bib": r"""@string{jos = "Journal of " # "Shapes"}
@article{One20, author = {One, Ada and Two, Bo}, title = {Round {Shapes}}, year = 2020, journal = jos, DOI = {10.1/x}}
@comment{ignored}
@book(Spare, title = "A \"quoted\" {T}itle", editor = {Three, Cy}, year = "1999")
""",
    },
    "broken": {
        "main.tex": r"""\newtheorem{thm}{Theorem}
\begin{document}
\begin{thm}\label{a} One. \end{thm}
\begin{thm}\label{a} Two, \ref{a}. \end{thm}
\begin{thm} Same. \end{thm}
\begin{thm} Same. \end{thm}
\input{main}
\input{../outside}
\end{document}
\begin{thm} never closed
""",
    },
}


def bundles(spark: SparkSession) -> DataFrame:
    """paper, path, text."""
    return spark.createDataFrame([(p, f, t) for p, files in PAPERS.items() for f, t in files.items()], "paper string, path string, text string")
