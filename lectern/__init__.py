"""Knowledge-base retrieval, exam analytics and corpus preparation as Spark jobs."""
