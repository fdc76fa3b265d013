"""Exam-content and corpus analytics as Spark jobs."""
