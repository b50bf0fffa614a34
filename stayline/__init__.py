"""Retention and workforce analytics as Spark jobs."""

from stayline.session import build_session, tune

__all__ = ["build_session", "tune"]
